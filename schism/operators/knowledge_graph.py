"""The typed knowledge graph: assembly, accessors, triples, samples (ids G9, G10, G15-G20, J12, J13, J17, J18, F16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways

EDGE = "src string, dst string, type string, predicate string, label string, weight double, observations bigint, positive_edges bigint, negative_edges bigint, frustration double"
_COLUMNS = [c.strip().split(" ")[0] for c in EDGE.split(",")]
_TYPES = dict(c.strip().split(" ") for c in EDGE.split(","))


def _edges(df: DataFrame, stage: int, **columns) -> DataFrame:
    return df.select(*(columns[c].cast(_TYPES[c]).alias(c) if c in columns else F.lit(None).cast(_TYPES[c]).alias(c) for c in _COLUMNS), F.lit(stage).alias("stage"))


def assemble(sag: DataFrame, entity_topics: DataFrame, groups: DataFrame, group_topics: DataFrame, dipoles: DataFrame, dipole_topics: DataFrame) -> DataFrame:
    """All typed edges; of several stages' edges of one (src, dst) the latest value of each attribute stays.

    sag: e1, e2, weight.  entity_topics: entity, topic, weight, observations, label.  groups: fid, entity.
    group_topics: fid, topic, weight, observations, label.  dipoles: f1, f2, pos, neg, f_g.
    dipole_topics: f1, f2, topic, pi, observations, label.
    """
    text = lambda c: F.col(c).cast("string")
    fellowship = lambda c: F.concat(F.lit("F"), text(c))
    dipole = F.concat(F.lit("D"), text("f1"), F.lit("_"), text("f2"))
    sign = F.when(F.col("weight") > 0, "POSITIVE").otherwise("NEGATIVE")
    both = both_ways(sag.select(text("e1").alias("e1"), text("e2").alias("e2"), "weight"), "e1", "e2", "s", "d", "weight")
    parts = [
        _edges(both, 1, src=F.col("s"), dst=F.col("d"), type=F.lit("Attitude"), predicate=sign, label=sign, weight=F.col("weight")),
        _edges(entity_topics, 2, src=text("entity"), dst=F.concat(F.lit("T:"), text("topic")), type=F.lit("Attitude"), predicate=F.col("label"), label=F.col("label"), weight=F.col("weight"), observations=F.col("observations")),
        _edges(groups, 3, src=text("entity"), dst=fellowship("fid"), type=F.lit("MemberOf")),
        _edges(group_topics, 3, src=fellowship("fid"), dst=F.concat(F.lit("T:"), text("topic")), type=F.lit("Attitude"), predicate=F.col("label"), label=F.col("label"), weight=F.col("weight"), observations=F.col("observations")),
        _edges(dipoles, 4, src=fellowship("f1"), dst=fellowship("f2"), type=F.lit("Conflict"), positive_edges=F.col("pos"), negative_edges=F.col("neg"), frustration=F.col("f_g")),
        _edges(dipoles.select("f1", "f2", F.explode(F.array("f1", "f2")).alias("f")), 4, src=fellowship("f"), dst=dipole, type=F.lit("PartOf")),
        _edges(dipole_topics, 5, src=dipole, dst=F.concat(F.lit("T:"), text("topic")), type=F.lit("Polarization"), predicate=F.col("label"), label=F.col("label"), weight=F.col("pi"), observations=F.col("observations")),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("stage"))).alias(c) for c in _COLUMNS[2:]]
    return union.groupBy("src", "dst").agg(*last)


def nodes(edges: DataFrame) -> DataFrame:
    """id and type: Fellowship, Dipole, Topic or Entity, by the roles of the edges they occur in."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("out")))).alias("e"), "type").select("e.*", "type")
    kind = (
        F.when(((F.col("type") == "PartOf") & ~F.col("out")) | ((F.col("type") == "Polarization") & F.col("out")), 3)
        .when(F.col("id").startswith("T:"), 2)
        .when((F.col("type") == "Conflict") | ((F.col("type") == "MemberOf") & ~F.col("out")) | ((F.col("type") == "PartOf") & F.col("out")), 1)
        .otherwise(0)
    )
    return ends.groupBy("id").agg(F.max(kind).alias("k")).select("id", F.element_at(F.array(*map(F.lit, ("Entity", "Fellowship", "Topic", "Dipole"))), F.col("k") + 1).alias("type"))


def of_type(node_table: DataFrame, kind: str) -> DataFrame:
    """F16."""
    return node_table.filter(F.col("type") == kind)


def neighbours(edges: DataFrame, node_table: DataFrame, kind: str | None = None) -> DataFrame:
    """Neighbours in the undirected view, by type."""
    both = both_ways(edges, "src", "dst", "node", "id").distinct()
    found = both.join(node_table, "id")
    return (found.filter(F.col("type") == kind) if kind else found).select("node", F.col("id").alias("neighbour"), "type")


#: Accessors by name, with the types of the node and of the neighbour that it gives.
ACCESSORS = {
    "fellowship_members": ("Fellowship", "Entity"), "fellowship_dipoles": ("Fellowship", "Dipole"), "dipole_fellowships": ("Dipole", "Fellowship"),
    "entity_fellowship": ("Entity", "Fellowship"), "entity_topics": ("Entity", "Topic"), "dipole_topics": ("Dipole", "Topic"),
}


def accessor(edges: DataFrame, node_table: DataFrame, name: str) -> DataFrame:
    """Node, neighbour of one of ACCESSORS, for all nodes of its type."""
    own, other = ACCESSORS[name]
    return neighbours(edges, node_table, other).join(of_type(node_table, own).select(F.col("id").alias("node")), "node", "left_semi").select("node", "neighbour")


def signed_neighbours(edges: DataFrame, positive: bool) -> DataFrame:
    """Entities (node, neighbour) joined by an attitude of that sign."""
    both = edges.filter("type = 'Attitude' and not startswith(dst, 'T:') and not startswith(src, 'F')")
    return both.filter(F.col("weight") > 0 if positive else F.col("weight") < 0).select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))


def entity_topic_attitudes(edges: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Node, topic, label of attitudes to topics (all, or those listed: topic)."""
    found = edges.filter("type = 'Attitude' and startswith(dst, 'T:')").select(F.col("src").alias("node"), F.col("dst").alias("topic"), "label")
    return found if topics is None else found.join(topics.select("topic").distinct(), "topic", "left_semi").select("node", "topic", "label")


def article_fellowships(nodes_of: DataFrame, edges: DataFrame) -> DataFrame:
    """Uid, fellowship of the entities (uid, id) of an article."""
    return nodes_of.join(members(edges).select(F.col("entity").alias("id"), "fellowship"), "id").select("uid", "fellowship").distinct()


def article_dipoles(fellowships: DataFrame, edges: DataFrame) -> DataFrame:
    """Uid, dipole of the pairs of an article's fellowships that are a dipole of the graph: an article's list of fellowships
    meets, for each of them, the list of those that it has a dipole with, so neither pairs nor the dipoles of one side become rows."""
    from ..sources.stages import small

    ends = edges.filter("type = 'PartOf'").select(F.col("src").alias("fellowship"), F.col("dst").alias("dipole")).distinct()
    pairs = ends.join(ends.withColumnRenamed("fellowship", "other"), "dipole").filter("fellowship < other").select("fellowship", "other", "dipole")
    sides = pairs.groupBy("fellowship").agg(F.collect_set("other").alias("others"))
    own = fellowships.groupBy("uid").agg(F.collect_set("fellowship").alias("own")).filter("uid is not null and size(own) > 1")
    met = small(own.select("uid", "own", F.explode("own").alias("fellowship")), sides, "fellowship").select("uid", "fellowship", F.explode(F.array_intersect("own", "others")).alias("other"))
    return small(met, pairs, "fellowship", "other").select("uid", "dipole")


def attitudes(edges: DataFrame, src: DataFrame | None = None) -> DataFrame:
    """Attitude edges, of given sources (id)."""
    found = edges.filter("type = 'Attitude'")
    return found.join(src.select(F.col("id").alias("src")), "src", "left_semi") if src is not None else found


def members(edges: DataFrame) -> DataFrame:
    return edges.filter("type = 'MemberOf'").select(F.col("dst").alias("fellowship"), F.col("src").alias("entity"))


def conflicts(edges: DataFrame) -> DataFrame:
    return edges.filter("type = 'Conflict'").select(F.col("src").alias("f1"), F.col("dst").alias("f2"), "positive_edges", "negative_edges", "frustration")


def polarization_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("type = 'Polarization'").select(F.col("src").alias("dipole"), F.col("dst").alias("topic"), F.col("weight").alias("pi"), "observations", "label")


def triples(edges: DataFrame, schema=None) -> DataFrame:
    """Subject, predicate (upper case; the type if absent), object, without NEUTRAL; schema: an optional DataFrame function."""
    out = edges.select(F.col("src").alias("subject"), F.upper(F.coalesce("predicate", "type")).alias("predicate"), F.col("dst").alias("object")).filter("predicate <> 'NEUTRAL'")
    return schema(out) if schema else out


def generic_graph(triple_table: DataFrame) -> DataFrame:
    """Both directions, weight 1, label = relation; the last label of a repeated edge by name."""
    t = triple_table.filter("subject <> object") if "subject" in triple_table.columns else triple_table
    both = both_ways(t, "subject", "object", "src", "dst", "predicate").withColumnRenamed("predicate", "label")
    return both.groupBy("src", "dst").agg(F.max("label").alias("label")).withColumn("weight", F.lit(1))


def known_triples(triple_table: DataFrame, entities: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Triples whose ends (and relation) have an embedding (name)."""
    for c in ("subject", "object"):
        triple_table = triple_table.join(entities.select(F.col("name").alias(c)), c, "left_semi")
    return triple_table.join(relations.select(F.col("name").alias("predicate")), "predicate", "left_semi") if relations is not None else triple_table


def article_nodes(ee: DataFrame, et: DataFrame) -> DataFrame:
    """Uid, id of the entities and topics of an article; the global edges among them add none, so no graph is formed."""
    pairs = ee.select("uid", F.explode(F.array(F.col("e1").cast("string"), F.col("e2").cast("string"))).alias("id"))
    return pairs.union(et.select("uid", F.explode(F.array(F.col("entity").cast("string"), F.concat(F.lit("T:"), F.col("topic").cast("string"))))).distinct()).distinct()


def article_graphs(ee: DataFrame, et: DataFrame, edges: DataFrame, scale: float = 1.0) -> DataFrame:
    """Per article (uid) mean attitudes of its pairs and topics, and the global edges among its nodes not already there.

    An article's rows are dealt by uid once; each of its nodes is staged with its own ends and with the other nodes of the
    article, and meets the global edges by both ends at once: never all edges of its entities."""
    from ..functions.numbers import sign_label
    from ..sources.stages import stage

    mean = (F.sum("num") / (F.count("*") * F.lit(scale))).alias("weight")
    own = ee.repartition("uid").groupBy("uid", F.col("e1").cast("string").alias("src"), F.col("e2").cast("string").alias("dst")).agg(mean)
    own = own.union(et.repartition("uid").groupBy("uid", F.col("entity").cast("string"), F.concat(F.lit("T:"), F.col("topic").cast("string"))).agg(mean))
    out = F.struct(F.col("src").alias("src"), F.struct("dst", "weight").alias("to"))
    ends = own.select("uid", F.explode(F.array(out, F.struct(F.col("dst").alias("src"), F.lit(None).alias("to")))).alias("e")).select("uid", "e.*")
    listed = ends.groupBy("uid", "src").agg(F.collect_list("to").alias("own"))
    topic = F.col("src").startswith("T:")
    kinds = edges.agg(*(F.coalesce(F.max(c), F.lit(False)).alias(name) for name, c in (("loops", F.col("src") == F.col("dst")), ("topics", topic))))
    others = F.array_except(F.collect_list("src").over(Window.partitionBy("uid")), F.concat(F.col("own.dst"), F.when(F.col("loops"), F.array().cast("array<string>")).otherwise(F.array("src"))))
    meets = F.col("uid").isNotNull() & F.col("src").isNotNull() & (F.col("topics") | ~topic)
    nodes = listed.crossJoin(F.broadcast(kinds)).withColumn("others", F.when(meets, others)).select("uid", "src", "own", "others")  # one row
    nodes = stage(nodes.filter("size(own) > 0 or size(others) > 0"), "article-nodes")
    own = nodes.select("uid", "src", F.explode("own").alias("to")).select("uid", "src", "to.dst", F.lit("Attitude").alias("type"), sign_label("to.weight").alias("label"), "to.weight")
    near = nodes.select("uid", "src", F.explode("others").alias("dst")).join(edges.select("src", "dst", "type", "label", "weight"), ["src", "dst"])
    return own.unionByName(near)


def tensors(samples: DataFrame, vectors: DataFrame | None = None, size: int = 200) -> DataFrame:
    """Samples (path, label, s, o) to sorted nodes, sorted index pairs without self loops, and features (zero vectors where unknown)."""
    rows = samples.filter("path is not null").repartition("path")  # dealt by path once: all that follows but the vectors stays there
    both = F.array(F.struct(F.lit(True).alias("first"), F.col("s").alias("node")), F.struct(F.lit(False).alias("first"), F.col("o").alias("node")))
    placed = rows.select("path", "label", "s", "o", F.explode(both).alias("e")).withColumn("i", F.dense_rank().over(Window.partitionBy("path").orderBy("e.node")) - 1)
    at = lambda first: F.max(F.when(F.col("e.first") == first, F.col("i")))
    pairs = placed.groupBy("path", "s", "o").agg(F.max("label").alias("label"), at(True).alias("i1"), at(False).alias("i2"))
    node = lambda i, c: F.collect_set(F.struct(F.col(i).alias("i"), F.col(c).alias("node")))
    edges = F.collect_set(F.when(F.col("s") != F.col("o"), F.struct(F.col("i1").alias("i"), F.col("i2").alias("j"))))
    found = pairs.groupBy("path").agg(F.max("label").alias("label"), F.array_sort(F.array_union(node("i1", "s"), node("i2", "o"))).alias("n"), F.array_sort(edges).alias("e"))
    out = [F.col("n.node").alias("nodes"), F.when(F.size("e") > 0, F.col("e")).alias("edge_index")]
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    if vectors is None:
        return found.select("path", "label", out[0], F.transform("n", lambda _: zero).alias("x"), out[1])
    known = found.select("path", F.explode("n").alias("m")).select("path", "m.*").join(vectors.select(F.col("name").alias("node"), "vector"), "node", "left")
    known = known.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("vector", zero).alias("x")))).alias("v"))
    return found.join(known, "path").select("path", "label", out[0], F.col("v.x").alias("x"), out[1])


def label_from_path(c: str = "path"):
    """Unreliable before Reliable, else null."""
    return F.when(F.col(c).contains("Unreliable"), 1).when(F.col(c).contains("Reliable"), 0)


#: Cells of the hash by which rows of a label are counted before the few at a border are ordered.
_CELLS = 4096


def _ranked(rows: DataFrame, label: str, key: str) -> DataFrame:
    """Adds __r, a row's number within its label in the order of a hash of its key: no task sees a whole label.

    Cells of the hash are counted (4,096 rows a label), added up, and rows numbered within their cell."""
    place = F.crc32(F.col(key).cast("string").cast("binary"))
    placed = rows.withColumns({"__h": place, "__c": F.floor(place / (2**32 / _CELLS)).cast("int")})
    cells = placed.groupBy(label, "__c").agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy(label).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(label, "__c").orderBy("__h", key))
    return placed.withColumn("__i", own).join(cells.select(label, "__c", before.alias("__b")), [label, "__c"]).withColumn("__r", F.col("__i") + F.col("__b")).drop("__h", "__c", "__i", "__b")


def balanced(rows: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of each label as of the rarest, those with the smallest hash of their key."""
    least = rows.groupBy(label).count().agg(F.min("count").alias("least"))
    return _ranked(rows, label, key).crossJoin(F.broadcast(least)).filter("__r <= least").drop("__r", "least").select(*rows.columns)  # one row


def stratified_split(rows: DataFrame, label: str, key: str, test_ratio: float = 0.2) -> DataFrame:
    """Column test: the first share of each label by a hash of the key."""
    total = rows.groupBy(label).agg(F.count("*").alias("__n"))
    return _ranked(rows, label, key).join(total, label).withColumn("test", F.col("__r") <= F.col("__n") * test_ratio).select(*rows.columns, "test")
