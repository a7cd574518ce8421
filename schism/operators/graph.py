"""The signed attitude graph and what is measured on it (ids G1, G11, A17, A24-A26, J8-J15, M2-M4, M8, U2)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import association, density, entity_mu


def signed_edges(labelled: DataFrame) -> DataFrame:
    """NEUTRAL pairs never become edges; weight 1 or -1."""
    return labelled.filter("label <> 'NEUTRAL'").select("e1", "e2", F.when(F.col("label") == "POSITIVE", 1).otherwise(-1).alias("weight"))


def node_ids(edges: DataFrame) -> DataFrame:
    """G1: ids 0.. by name, for exports; numbered range by range."""
    from .ranges import running_sum

    nodes = edges.select(F.explode(F.array("e1", "e2")).alias("entity")).distinct().withColumn("one", F.lit(1))
    return running_sum(nodes, ["entity"], "one", "id").select(F.col("id").cast("int").alias("id"), "entity")


def both_ways(df: DataFrame, a: str, b: str, first: str, second: str, *columns: str) -> DataFrame:
    """U4: each row in both directions, in one pass over df (a union would work its plan out twice)."""
    ends = F.array(F.struct(F.col(a).alias(first), F.col(b).alias(second)), F.struct(F.col(b).alias(first), F.col(a).alias(second)))
    return df.select(F.explode(ends).alias("__ends"), *columns).select("__ends.*", *columns)


def adjacency(edges: DataFrame) -> DataFrame:
    """U4: both directions: node, other, weight."""
    return both_ways(edges, "e1", "e2", "node", "other", "weight")


def polarity_mix(edges: DataFrame) -> DataFrame:
    """Positive and negative neighbours of each entity and mu."""
    signs = adjacency(edges).groupBy(F.col("node").alias("entity")).agg(F.sum((F.col("weight") > 0).cast("int")).alias("pos"), F.sum((F.col("weight") < 0).cast("int")).alias("neg"))
    return signs.withColumn("mu", entity_mu("pos", "neg"))


def degree(edges: DataFrame) -> DataFrame:
    """M8: degree and weighted degree."""
    return adjacency(edges).groupBy(F.col("node").alias("entity")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def common_neighbours(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """For pairs (a < b; all with a common neighbour, or those given as e1, e2) the sizes of the intersections.

    both, and by sign of a's and b's edge: pp, pn, np, nn.
    """
    adj = adjacency(edges)
    a = adj.select(F.col("node").alias("a"), "other", F.col("weight").alias("wa"))
    b = adj.select(F.col("node").alias("b"), "other", F.col("weight").alias("wb"))
    if pairs is not None:
        wanted = pairs.select(F.col("e1").alias("a"), F.col("e2").alias("b")).distinct()
        both = wanted.join(a, "a").join(b, ["b", "other"])
    else:
        both = a.join(b, "other").filter("a < b")
    count = lambda x, y: F.sum(((F.col("wa") == x) & (F.col("wb") == y)).cast("int"))
    return both.groupBy("a", "b").agg(F.count("*").alias("both"), count(1, 1).alias("pp"), count(1, -1).alias("pn"), count(-1, 1).alias("np"), count(-1, -1).alias("nn"))


def _sizes(edges: DataFrame) -> DataFrame:
    return polarity_mix(edges).select("entity", "pos", "neg", (F.col("pos") + F.col("neg")).alias("deg"))


def semantic_distance(edges: DataFrame) -> DataFrame:
    """M2 for the pairs with a common neighbour (the others' value depends on the two degrees alone)."""
    size = _sizes(edges).select("entity", "deg")
    n = size.agg(F.count("*").alias("n"))
    out = common_neighbours(edges).join(size.select(F.col("entity").alias("a"), F.col("deg").alias("da")), "a").join(size.select(F.col("entity").alias("b"), F.col("deg").alias("db")), "b")
    return out.crossJoin(F.broadcast(n)).select("a", "b", "both", association("da", "db", "both", "n").alias("distance"))  # one row


def semantic_totals(edges: DataFrame) -> DataFrame:
    """Per entity the sum of M2 over all other entities, without forming all pairs.

    A pair without overlap contributes ln max(d) / (ln N - ln min(d)), a function of the degrees: those are summed
    over the degree histogram (as many rows as there are degrees), and pairs with overlap corrected.
    """
    size = _sizes(edges).select("entity", "deg")
    n = size.agg(F.count("*").alias("n"))
    kinds = size.groupBy("deg").agg(F.count("*").alias("k"))
    apart = association("deg", "d2", F.lit(0), "n")
    other = kinds.select(F.col("deg").alias("d2"), F.col("k").alias("k2"))
    by_degree = kinds.crossJoin(F.broadcast(other)).crossJoin(F.broadcast(n))  # degrees, not entities
    by_degree = by_degree.groupBy("deg").agg(F.sum(apart * (F.col("k2") - (F.col("deg") == F.col("d2")).cast("int"))).alias("base"))
    near = common_neighbours(edges).join(size.select(F.col("entity").alias("a"), F.col("deg").alias("deg")), "a").join(size.select(F.col("entity").alias("b"), F.col("deg").alias("d2")), "b").crossJoin(F.broadcast(n))
    near = near.select("a", "b", (association("deg", "d2", "both", "n") - apart).alias("gain"))
    gains = both_ways(near, "a", "b", "entity", "other", "gain").groupBy("entity").agg(F.sum("gain").alias("gain"))
    return size.join(by_degree, "deg").join(gains, "entity", "left").select("entity", (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("semantic_association"))


def signed_association(edges: DataFrame) -> DataFrame:
    """M3/M4 per edge: agreement of the ends' signed neighbourhoods, negated on negative edges."""
    size = _sizes(edges)
    n = size.agg(F.count("*").alias("n"))
    e = edges.join(common_neighbours(edges, edges).withColumnsRenamed({"a": "e1", "b": "e2"}), ["e1", "e2"], "left")
    for end in ("1", "2"):
        e = e.join(size.select(F.col("entity").alias(f"e{end}"), F.col("pos").alias(f"p{end}"), F.col("neg").alias(f"n{end}")), f"e{end}")
    e = e.crossJoin(F.broadcast(n))  # one row
    sa = lambda x, y, z: association(x, y, z, "n", zero_when_apart=True)
    return e.select("e1", "e2", "weight", F.when(F.col("weight") > 0, sa("p1", "p2", "pp") + sa("n1", "n2", "nn")).otherwise(-sa("p1", "n2", "pn") - sa("n1", "p2", "np")).alias("ssa"))


def signed_association_totals(edges: DataFrame) -> DataFrame:
    """Sum of M4 over an entity's edges."""
    return adjacency(signed_association(edges).select("e1", "e2", F.col("ssa").alias("weight"))).groupBy(F.col("node").alias("entity")).agg(F.sum("weight").alias("ssa"))


def triads(edges: DataFrame) -> DataFrame:
    """Triangles a < b < c by number of positive edges, and their share."""
    ab, bc, ac = (edges.select(F.col("e1").alias(x), F.col("e2").alias(y), F.col("weight").alias(f"w{x}{y}")) for x, y in ("ab", "bc", "ac"))
    pos = sum((F.col(c) > 0).cast("int") for c in ("wab", "wbc", "wac"))
    count = ab.join(bc, "b").join(ac, ["a", "c"]).groupBy(pos.alias("positive")).agg(F.count("*").alias("n"))
    spark = edges.sparkSession
    kinds = spark.createDataFrame([(3, "+++"), (2, "++-"), (1, "+--"), (0, "---")], "positive int, kind string")
    found = kinds.join(count, "positive", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
    total = found.agg(F.sum("n").alias("t"))
    return found.crossJoin(F.broadcast(total)).select("kind", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("t").cast("double")), F.lit(0.0)).alias("share"))  # one row


def with_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Both ends' fellowships (fid, entity)."""
    return edges.join(groups.select(F.col("entity").alias("e1"), F.col("fid").alias("f1")), "e1").join(groups.select(F.col("entity").alias("e2"), F.col("fid").alias("f2")), "e2")


def connected_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Sorted pairs of different fellowships with an edge across."""
    return with_groups(edges, groups).filter("f1 <> f2").select(F.least("f1", "f2").alias("f1"), F.greatest("f1", "f2").alias("f2")).distinct()


def group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges with both ends in a fellowship."""
    return with_groups(edges, groups).filter("f1 = f2").select(F.col("f1").alias("fid"), "e1", "e2", "weight")


def dipole_candidates(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """A10: per pair of fellowships the signs across; pairs without a negative edge are none."""
    across = with_groups(edges, groups).filter("f1 <> f2").groupBy(F.least("f1", "f2").alias("f1"), F.greatest("f1", "f2").alias("f2"))
    signs = across.agg(F.sum((F.col("weight") > 0).cast("int")).alias("pos"), F.sum((F.col("weight") < 0).cast("int")).alias("neg")).filter("neg > 0")
    return signs.withColumns({"negative_ratio": F.col("neg") / (F.col("pos") + F.col("neg")), "positive_ratio": F.col("pos") / (F.col("pos") + F.col("neg"))})


def dipole_edges(edges: DataFrame, groups: DataFrame, dipoles: DataFrame) -> DataFrame:
    """Edges induced by the union of a dipole's two fellowships."""
    e = with_groups(edges, groups).withColumnsRenamed({"f1": "x", "f2": "y"}).withColumns({"lo": F.least("x", "y"), "hi": F.greatest("x", "y")})
    d = dipoles.select("f1", "f2")
    across = e.filter("x <> y").join(d, (F.col("lo") == F.col("f1")) & (F.col("hi") == F.col("f2")))
    inside = e.filter("x = y")
    sides = d.select("f1", "f2", F.explode(F.array("f1", "f2")).alias("x"))
    cols = ["f1", "f2", "e1", "e2", "weight"]
    return across.select(cols).unionByName(inside.join(sides, "x").select(cols))


def signed_jaccard(edges: DataFrame) -> DataFrame:
    """U2 per edge: (agreeing - opposing) / union of the ends' neighbourhoods; each node is in its own positive set."""
    loops = adjacency(edges).select("node").distinct().select("node", F.col("node").alias("other"), F.lit(1).alias("weight"))
    own = adjacency(edges).union(loops)
    size = own.groupBy("node").agg(F.count("*").alias("size"))
    a, b = own.select(F.col("node").alias("e1"), "other", F.col("weight").alias("w1")), own.select(F.col("node").alias("e2"), "other", F.col("weight").alias("w2"))
    same = edges.select("e1", "e2").join(a, "e1").join(b, ["e2", "other"]).groupBy("e1", "e2").agg(F.sum(F.col("w1") * F.col("w2")).alias("net"), F.count("*").alias("both"))
    s1, s2 = size.select(F.col("node").alias("e1"), F.col("size").alias("s1")), size.select(F.col("node").alias("e2"), F.col("size").alias("s2"))
    out = edges.join(same, ["e1", "e2"], "left").join(s1, "e1").join(s2, "e2")
    return out.select("e1", "e2", "weight", (F.coalesce("net", F.lit(0)) / (F.col("s1") + F.col("s2") - F.coalesce("both", F.lit(0)))).alias("similarity"))


def closeness(edges: DataFrame) -> DataFrame:
    """M8: (reached - 1) / sum of distances, by a frontier join per distance; stops when no pair is new."""
    from ..sources.stages import stage

    step = adjacency(edges).select("node", "other")
    seen = stage(step.select("node").distinct().select(F.col("node").alias("source"), "node", F.lit(0).alias("d")), "closeness")
    front = seen
    for d in itertools.count(1):
        front = front.select("source", "node").join(step, "node").select("source", F.col("other").alias("node")).distinct()
        front = stage(front.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("d", F.lit(d)), "closeness")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.groupBy(F.col("source").alias("entity")).agg(F.coalesce(F.try_divide((F.count("*") - 1).cast("double"), F.sum("d").cast("double")), F.lit(0.0)).alias("closeness"))


#: Most edges of a graph that each task of `betweenness` holds (8 bytes a direction).
BETWEENNESS_EDGES = 2_000_000


def betweenness(edges: DataFrame) -> DataFrame:
    """M8: share of shortest paths between other nodes that pass a node, over all ordered pairs.

    Sources are dealt to tasks; each holds the adjacency (a broadcast of checked size; larger graphs are refused), goes
    breadth first from its sources and hands on one sum per node."""
    import numpy as np
    import pandas as pd

    if edges.limit(BETWEENNESS_EDGES + 1).count() > BETWEENNESS_EDGES:
        raise ValueError(f"over {BETWEENNESS_EDGES} edges")
    spark, kind = edges.sparkSession, dict(edges.dtypes)["e1"]
    table = adjacency(edges).select("node", "other").toPandas()
    names, index = np.unique(np.concatenate([table["node"], table["other"]]), return_inverse=True)
    start, end = index[: len(table)], index[len(table) :]
    order = np.argsort(start, kind="stable")
    shared = spark.sparkContext.broadcast((np.searchsorted(start[order], np.arange(len(names) + 1)), end[order].astype(np.int32)))
    n = len(names)

    def run(frames):
        first, near = shared.value
        total = np.zeros(n)
        for frame in frames:
            for s in frame["id"]:
                depth, paths, levels = np.full(n, -1), np.zeros(n), [np.array([s])]
                depth[s], paths[s] = 0, 1
                hops = []
                while len(levels[-1]):
                    own = levels[-1]
                    a = np.repeat(own, first[own + 1] - first[own])
                    b = np.concatenate([near[first[x] : first[x + 1]] for x in own]) if len(own) else near[:0]
                    onward = (depth[b] < 0) | (depth[b] == len(levels))
                    a, b = a[onward], b[onward]
                    depth[b] = len(levels)
                    paths += np.bincount(b, paths[a], n)
                    hops.append((a, b))
                    levels.append(np.unique(b))
                share = np.zeros(n)
                for a, b in reversed(hops):
                    share += np.bincount(a, paths[a] / np.maximum(paths[b], 1) * (1 + share[b]), n)
                share[s] = 0
                total += share
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": at, "share": total[at]})

    sums = spark.range(n).mapInPandas(run, "i long, share double").groupBy("i").agg(F.sum("share").alias("share"))
    named = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "entity": names}), f"i long, entity {kind}") if n else spark.createDataFrame([], f"i long, entity {kind}")
    pairs = float(max((n - 1) * (n - 2), 1))
    return named.join(sums, "i", "left").select("entity", (F.coalesce("share", F.lit(0.0)) / pairs).alias("betweenness"))


#: Most edges that are handed to a scorer of whole graphs.
SCORED_EDGES = 2_000_000


def _scored(edges: DataFrame, run, schema: str) -> DataFrame:
    """What `run` makes of the whole edge list (of checked size), sorted, with the nodes numbered by name."""
    import numpy as np
    import pandas as pd

    if edges.limit(SCORED_EDGES + 1).count() > SCORED_EDGES:
        raise ValueError(f"over {SCORED_EDGES} edges")

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        names, index = np.unique(np.concatenate([frame["e1"], frame["e2"]]), return_inverse=True)
        ends = np.sort(index.reshape(2, -1), axis=0).tolist()
        return run(names, sorted(zip(*ends, frame["weight"].tolist())))

    return edges.groupBy(F.lit(0).alias("graph")).applyInPandas(whole, schema)


def node_scores(edges: DataFrame, score=None) -> DataFrame:
    """Entity, pole: what a scorer that is plugged in gives each node: (number of nodes, [(u, v, weight)]) -> a value per node number.

    Without a scorer every value is null."""
    import pandas as pd

    kind = dict(edges.dtypes)["e1"]
    if score is None:
        return edges.select(F.explode(F.array("e1", "e2")).alias("entity")).distinct().withColumn("pole", F.lit(None).cast("double"))
    return _scored(edges, lambda names, rows: pd.DataFrame({"entity": names, "pole": pd.Series(list(score(len(names), rows)), dtype="float64")}), f"entity {kind}, pole double")


def graph_score(edges: DataFrame, score, without=None) -> DataFrame:
    """One row, pole: the scorer's value of the graph, or of what is left without a node; no row if no edge is left."""
    import pandas as pd

    left = edges if without is None else edges.filter((F.col("e1") != F.lit(without)) & (F.col("e2") != F.lit(without)))
    return _scored(left, lambda names, rows: pd.DataFrame({"pole": [float(score(len(names), rows))]}), "pole double")


def group_density(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """A21 (structure): per fellowship, edges in both directions, densities of all, positive and negative edges."""
    e = group_edges(edges, groups)
    ends = both_ways(e, "e1", "e2", "node", "other", "fid", "weight")
    nodes = groups.groupBy("fid").agg(F.count_distinct("entity").alias("size"))
    signs = e.groupBy("fid").agg(F.count("*").alias("m"), F.sum((F.col("weight") > 0).cast("int")).alias("mp"), F.sum((F.col("weight") < 0).cast("int")).alias("mn"))
    own = ends.groupBy("fid").agg(F.count_distinct(F.when(F.col("weight") > 0, F.col("node"))).alias("np"), F.count_distinct(F.when(F.col("weight") < 0, F.col("node"))).alias("nn"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = nodes.join(signs, "fid", "left").join(own, "fid", "left")
    return out.select(
        "fid", "size", (2 * z("m")).alias("edges"), (2 * z("mp")).alias("positive"), (2 * z("mn")).alias("negative"),
        density(2 * z("m"), "size", directed=True).alias("density"), density(z("mp"), z("np")).alias("positive_density"), density(z("mn"), z("nn")).alias("negative_density"),
    )
