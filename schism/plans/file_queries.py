"""Queries of sources and sinks: each writes its files into the shared folder from a test table and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import attitudes, communities, entities, features, graph, learning, metrics, syntax
from ..sources import annotators, readers
from ..sources.stages import shared_folder
from . import tables as t
from .registry import _r, query
from .tables import spread, sql, table


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(spark, rows, name: str, order: str | None = None, **options) -> str:
    """Path of text files with the rows' column `value`; with `order`, one file in that order (a lexicon, small by nature)."""
    path = _folder(spark, name)
    rows = rows.repartition(1).sortWithinPartitions(order).select("value") if order else rows
    rows.write.options(**options).text(path)
    return path


# -- events and articles


@query("SELECT page_id AS globaleventid, '2023111' || CAST(page_id % 10 AS VARCHAR) AS day, 'GRC' AS actor1countrycode, CAST(page_id AS DOUBLE) / 4 AS avgtone, url AS sourceurl FROM pages")
def s2_gdelt_scan(spark, sf):
    names = readers.gdelt_columns()
    own = {"globaleventid": F.col("page_id").cast("string"), "day": F.concat(F.lit("2023111"), (F.col("page_id") % 10).cast("string")), "actor1countrycode": F.lit("GRC"), "avgtone": (F.col("page_id") / 4).cast("string"), "sourceurl": F.col("url")}
    lines = table(spark, sf, "pages").select(F.concat_ws("\t", *(own.get(n, F.lit("")) for n in names)).alias("value"))
    return readers.gdelt(spark, _lines(spark, lines, "gdelt", compression="gzip")).select("globaleventid", "day", "actor1countrycode", "avgtone", "sourceurl")


@query("SELECT url, CASE WHEN url LIKE '%7%' THEN NULL ELSE '<title>' || url || '</title>' END AS html, CASE WHEN url LIKE '%7%' THEN 'KeyError' END AS error FROM (SELECT DISTINCT url FROM pages)")
def s3_fetch(spark, sf):
    """A getter without a network: some addresses fail, and say why."""

    def load():
        def get(url: str) -> str:
            if "7" in url:
                raise KeyError(url)
            return f"<title>{url}</title>"

        return get

    return annotators.fetch(table(spark, sf, "pages").select("url").distinct(), load)


@query("SELECT url, html FROM pages")
def s3_fetched_before(spark, sf):
    """The offline source: addresses meet a table of pages that were fetched before."""
    pages = table(spark, sf, "pages")
    return annotators.fetched(pages.select("url").distinct(), pages.select("url", "html"))


@query("SELECT n_name AS uid, 'http://x/' || n_nationkey AS url, n_name || ' says \"yes\"' AS text, r_name AS title FROM nation JOIN region ON r_regionkey = n_regionkey")
def s5_s6_json_articles(spark, sf):
    """One JSON file an article, in folders; every second one is a string that holds the object."""
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    said = F.concat("n_name", F.lit(' says "yes"'))
    rows = table(spark, sf, "nation").join(regions, "n_regionkey").select("n_regionkey", "n_nationkey", F.to_json(F.struct(F.col("n_name").alias("uid"), F.concat(F.lit("http://x/"), F.col("n_nationkey").cast("string")).alias("url"), said.alias("text"), F.col("r_name").alias("title"))).alias("value"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    rows = rows.withColumn("value", F.when(F.col("n_nationkey") % 2 == 1, quoted).otherwise(F.col("value"))).drop("n_nationkey")
    path = _folder(spark, "articles")
    rows.write.partitionBy("n_regionkey").option("maxRecordsPerFile", 1).text(path)
    return readers.articles(spark, path).select("uid", "url", "text", "title")


@query("SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages WHERE regexp_matches(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'org|net')")
def f4_domains(spark, sf):
    events = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("day"), F.col("url").alias("sourceurl"))
    found = readers.select_articles(events, domains=("org", "net"), n_articles=None)
    return found.select(F.col("day").cast("long").alias("page_id"), F.regexp_extract("sourceurl", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1).alias("host"))


# -- topics, fellowships, graphs, tables


_TOPICS = "SELECT p_type AS topic_id, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS INT) AS pos, p_name AS np, lower(p_name) AS clean_np, CAST(p_size AS DOUBLE) / 64 AS similarity FROM part"


@query(_TOPICS)
def s8_topics(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("topic_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("np"), F.lower("p_name").alias("clean_np"), (F.col("p_size").cast("double") / 64).alias("similarity"))
    path = _folder(spark, "topics")
    readers.write_topics(rows, path)
    return readers.topics(spark, path)


@query(sql("SELECT fid, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY entity) AS members FROM fellows GROUP BY fid", "fellows"))
def s9_fellowships(spark, sf):
    path = _folder(spark, "fellowships")
    readers.write_fellowships(t.groups(spark, sf), path)
    return spark.read.schema("fid int, members array<long>").json(path).select("fid", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(sql(""", n AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS INT) AS id FROM (SELECT DISTINCT node FROM adj))
SELECT 'edge' AS kind, x.id AS a, y.id AS b, weight AS value FROM sag JOIN n x ON x.node = e1 JOIN n y ON y.node = e2 UNION ALL SELECT 'dipole', f1, f2, CAST(neg AS INT) FROM cand""", "adj", "cand"))
def s10_graph_tables(spark, sf):
    """Edges, ids and dipoles written as one graph, and read again: edges by id."""
    path = _folder(spark, "graph")
    edges = t.sag_table(spark, sf)
    readers.write_graph(path, edges, t.candidates(spark, sf))
    g = readers.read_graph(spark, path)
    at = lambda a, b: g["ids"].select(F.col("entity").alias(a), F.col("id").alias(b))
    own = g["edges"].join(at("e1", "a"), "e1").join(at("e2", "b"), "e2").select(F.lit("edge").alias("kind"), "a", "b", F.col("weight").alias("value"))
    return own.unionByName(g["dipoles"].select(F.lit("dipole").alias("kind"), F.col("f1").alias("a"), F.col("f2").alias("b"), F.col("neg").cast("int").alias("value")))


@query("SELECT l_orderkey AS uid, l_linenumber AS sent_ix, l_suppkey AS entity, l_discount AS attitude FROM lineitem")
def s7_attitude_tables(spark, sf):
    """The attitudes of a stage, written once and scanned by column."""
    path = _folder(spark, "attitudes")
    table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("sent_ix"), F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("np"), F.col("l_discount").alias("attitude")).write.parquet(path)
    return readers.attitude_table(spark, path).select("uid", "sent_ix", "entity", "attitude")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s11_csv(spark, sf):
    path = _folder(spark, "csv")
    readers.write_csv(table(spark, sf, "nation"), path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").option("header", True).csv(path)


# -- lexicons


@query("SELECT lower(replace(n_name, ' ', '-')) AS word, CASE n_regionkey WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'both' ELSE 'neutral' END AS polarity FROM nation")
def s14_subjectivity_lexicon(spark, sf):
    """Every word twice; the later line counts."""
    word = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    polarity = F.when(F.col("n_regionkey") == 0, "positive").when(F.col("n_regionkey") == 1, "negative").when(F.col("n_regionkey") == 2, "both").otherwise("neutral")
    line = lambda p: F.concat(F.lit("type=weaksubj len=1 word1="), word, F.lit(" pos1=noun stemmed1=n priorpolarity="), p)
    rows = table(spark, sf, "nation")
    rows = rows.select(F.col("n_nationkey").alias("at"), line(F.lit("negative")).alias("value")).union(rows.select(F.col("n_nationkey") + 100, line(polarity)))
    return readers.subjectivity_lexicon(spark, _lines(spark, rows, "subjectivity", "at"))


@query("SELECT lower(n_name) || '*' AS pattern, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT LIKE '% %' UNION ALL SELECT lower(n_name) || '*', 'AFRICA' FROM nation WHERE n_name NOT LIKE '% %' AND n_regionkey <> 0")
def s15_category_dictionary(spark, sf):
    heads = table(spark, sf, "region").select((F.col("r_regionkey") + 10).alias("at"), F.concat((F.col("r_regionkey") + 1).cast("string"), F.lit("\t"), "r_name").alias("value"))
    ids = F.when(F.col("n_regionkey") == 0, "1").otherwise(F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("\t1")))
    words = table(spark, sf, "nation").filter("n_name not like '% %'").select((F.col("n_nationkey") + 100).alias("at"), F.concat(F.lower("n_name"), F.lit("*\t"), ids).alias("value"))
    marks = spark.createDataFrame([(0, "%"), (99, "%")], "at int, value string")
    return readers.category_dictionary_file(spark, _lines(spark, marks.union(heads).union(words), "categories", "at"))


@query("SELECT DISTINCT lower(p_type) AS term FROM part UNION SELECT lower(trim(n_name)) FROM nation")
def s16_s19_word_list(spark, sf):
    """With comments, empty lines, spaces around terms and repeated ones."""
    rows = table(spark, sf, "part").select(F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("value")).union(table(spark, sf, "nation").select("n_name")).union(table(spark, sf, "nation").select(F.concat(F.lit("# "), "n_name")))
    return readers.word_list(spark, _lines(spark, rows.union(spark.createDataFrame([("",), ("a\tb",)], "value string")), "words"), sep="\t")


@query("SELECT lower(n_name) AS term, CAST(n_regionkey AS DOUBLE) - 2 AS score FROM nation")
def s17_weighted_list(spark, sf):
    rows = table(spark, sf, "nation")
    line = lambda score: F.concat_ws("\t", F.lower("n_name"), score.cast("string"))
    both = rows.select(F.col("n_nationkey").alias("at"), line(F.lit(9)).alias("value")).union(rows.select(F.col("n_nationkey") + 100, line(F.col("n_regionkey") - 2)))
    return readers.weighted_list(spark, _lines(spark, both, "weighted", "at"))


@query("SELECT 'places_' || lower(replace(r_name, ' ', '_')) AS category, n_name AS term FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'segments', c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def s18_nested_lexicon(spark, sf):
    """A YAML file of two levels, with lists in both styles."""
    regions = table(spark, sf, "region").select("r_regionkey", F.concat(F.lit("  "), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit(":")).alias("value"))
    own = table(spark, sf, "nation").select((F.col("n_regionkey") * 100 + 1 + F.col("n_nationkey")).alias("at"), F.concat(F.lit('    - "'), "n_name", F.lit('"')).alias("value"))
    flat = table(spark, sf, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s")).select(F.lit(10_000).alias("at"), F.concat(F.lit("Segments: ["), F.array_join("s", ", "), F.lit("]")).alias("value"))
    rows = spark.createDataFrame([(-2, "# places"), (-1, "Places:")], "at int, value string").union(regions.select((F.col("r_regionkey") * 100).alias("at"), "value")).union(own).union(flat)
    return readers.nested_lexicon_file(spark, _lines(spark, rows, "yaml", "at"))


@query("SELECT lower(n_name) AS term, 'fear' AS category FROM nation WHERE n_regionkey = 1 UNION ALL SELECT lower(n_name), 'joy' FROM nation")
def s20_emotions(spark, sf):
    line = lambda emotion, on: F.concat_ws("\t", F.lower("n_name"), F.lit(emotion), on.cast("int").cast("string"))
    rows = table(spark, sf, "nation")
    return readers.emotion_table(spark, _lines(spark, rows.select(line("fear", F.col("n_regionkey") == 1).alias("value")).union(rows.select(line("joy", F.lit(True)))), "emotions"))


# -- annotators


_NAMES = [("house", "House"), ("the house", "The house"), ("time", "Time"), ("data", "Data"), ("of the", "Of the")]


@query("""WITH g(name, title) AS (VALUES """ + ", ".join(map(str, _NAMES)) + r"""), s AS (SELECT conv_id, turn, text, ' ' || array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g'), '\s+'), lambda x: x <> ''), ' ') || ' ' AS clean FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS uid, turn AS sent_ix, title, instr(text, name) - 1 AS begin, instr(text, name) - 1 + len(name) AS "end" FROM s JOIN g ON contains(clean, ' ' || name || ' ') AND instr(text, name) > 0""")
def s21_s25_gazetteer_entities(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("uid"), F.col("turn").alias("sent_ix"), F.col("text").alias("sentence"))
    return readers.gazetteer_entities(rows, spark.createDataFrame(_NAMES, "name string, title string")).select("uid", "sent_ix", "title", "begin", "end")


_VERBS = "is|are|was|were|has|have|had"


@query(rf"""SELECT conv_id, turn, regexp_extract(text, '^(.*?) ({_VERBS}) (.*)$', 1, 's') AS subject, regexp_extract(text, '^(.*?) ({_VERBS}) (.*)$', 2, 's') AS relation, regexp_extract(text, '^(.*?) ({_VERBS}) (.*)$', 3, 's') AS object FROM conversations WHERE regexp_matches(text, '^.*? ({_VERBS}) .*$', 's')""")
def s23_open_triples(spark, sf):
    """Triples of the default extractor, plugged in as any other."""
    rows = annotators.open_triples(table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("sentence")))
    return rows.select("conv_id", "turn", F.explode("triples").alias("t")).select("conv_id", "turn", "t.*")


@query(rf"""SELECT conv_id, turn, regexp_extract(text, '^(.*?) ({_VERBS}) (.*)$', 2, 's') AS verb, regexp_extract(text, '^(.*?) ({_VERBS}) (.*)$', 1, 's') AS arg0, regexp_extract(text, '^(.*?) ({_VERBS}) (.*)$', 3, 's') AS arg1 FROM conversations WHERE regexp_matches(text, '^.*? ({_VERBS}) .*$', 's')""")
def s24_semantic_roles(spark, sf):
    rows = annotators.semantic_roles(table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("sentence")))
    return rows.select("conv_id", "turn", F.explode("frames").alias("f")).select("conv_id", "turn", "f.*")


@query()
def l11_encoded(spark, sf):
    """Vectors of the default encoder (hashed words of unit length); tests hold it against a loop."""
    return annotators.encode(table(spark, sf, "documents").select("doc_id", F.col("text").alias("sentence"))).select("doc_id", "embedding")


# -- sentences, attitudes, coreference, trees, models


@query("SELECT conv_id, turn FROM conversations WHERE len(text) <= 200 AND len(trim(text)) > 5")
def f6_f7_within(spark, sf):
    return attitudes.within(table(spark, sf, "conversations"), "text", 200, 5).select("conv_id", "turn")


_POLAR = [("the", "positive"), ("and", "negative"), ("of", "both"), ("der", "neutral"), ("la", "positive"), ("is", "negative"), ("victory", "positive")]


@query(sql(", lex(w, p) AS (VALUES " + ", ".join(map(str, _POLAR)) + """), k2 AS (SELECT doc_id, sum(k) FILTER (WHERE p IN ('positive', 'both')) AS p, sum(k) FILTER (WHERE p IN ('negative', 'both')) AS n FROM counts LEFT JOIN lex ON w = rtrim(word, '.') WHERE word <> 'victory' GROUP BY doc_id)
SELECT doc_id, round(coalesce((coalesce(p, 0) - coalesce(n, 0)) / nullif(CAST(coalesce(p, 0) + coalesce(n, 0) AS DOUBLE), 0), 0), 6) AS polarity FROM k2""", "counts"))
def a1_polarity(spark, sf):
    """Words as tokens, without the full stops behind them as lemmas."""
    tokens = features.tokens(table(spark, sf, "documents")).select("doc_id", F.col("word").alias("text"), F.rtrim(F.col("word"), F.lit(".")).alias("lemma"))
    return attitudes.polarity(tokens, spark.createDataFrame(_POLAR, "word string, polarity string"), ["doc_id"], ("victory",)).select("doc_id", _r("polarity"))


@query(sql("SELECT sent, round(coalesce(avg(nullif(CAST(tone AS DOUBLE), 0)), 0), 6) AS attitude FROM mentions GROUP BY sent", "mentions"))
def a2_sentence_attitude(spark, sf):
    return attitudes.sentence_attitude(t.mentions(spark, sf).withColumn("polarity", F.col("tone").cast("double")), ["sent"]).select("sent", _r("attitude"))


@query("SELECT p_partkey AS uid, p_brand || ' met ' || p_brand || ', and ' || p_brand || ' left' AS text FROM part")
def x11_resolved(spark, sf):
    """'him' and 'he' point at the brand in front."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("uid"), F.concat("p_brand", F.lit(" met him, and he left")).alias("text"), F.length("p_brand").alias("n"))
    spans = F.array(*(F.struct((F.lit(b) + (F.col("n") if m else F.lit(0))).alias("begin"), (F.lit(e) + F.col("n")).alias("end")) for b, e, m in ((0, 0, False), (5, 8, True), (14, 16, True))))
    clusters = rows.select("uid", F.lit(0).alias("cluster"), F.explode(spans).alias("s")).select("uid", "cluster", "s.*")
    return entities.resolve_coreference(rows.select("uid", "text"), clusters)


@query("SELECT p_partkey AS uid, b AS begin, b + 2 AS \"end\", p_brand AS title FROM part, (VALUES (0), (10), (20)) v(b)")
def x12_propagated(spark, sf):
    part = table(spark, sf, "part")
    found = part.select(F.col("p_partkey").alias("uid"), F.lit(1).alias("begin"), F.lit(2).alias("end"), F.col("p_brand").alias("title"))
    clusters = part.select(F.col("p_partkey").alias("uid"), F.lit(0).alias("cluster"), F.explode(F.array(F.lit(0), F.lit(10), F.lit(20))).alias("begin")).withColumn("end", F.col("begin") + 2)
    return entities.propagate_entities(found, clusters).filter("end - begin = 2")


def _parses(spark, sf):
    """A bracketed parse of each part: a noun phrase in it for every point of its size, a verb phrase around all."""
    deep = F.concat(F.repeat(F.lit("(NP "), F.col("p_size")), F.lit("(NN x)"), F.repeat(F.lit(")"), F.col("p_size")))
    return spread(table(spark, sf, "part")).select("p_partkey", F.concat(F.lit("(S (NP (NN y)) (VP (VB is) "), deep, F.lit("))")).alias("parse"))


@query("SELECT p_partkey, CAST(p_size + 3 AS DOUBLE) AS depth, CAST(p_size + 1 AS DOUBLE) AS np_count, round((2 + p_size * (p_size + 3) / 2.0) / (p_size + 1), 6) AS np_depth, CAST(1 AS DOUBLE) AS vp_count, CAST(p_size + 2 AS DOUBLE) AS vp_depth FROM part")
def x27_complexity(spark, sf):
    rows = syntax.complexities(_parses(spark, sf), "parse")
    return rows.select("p_partkey", "depth", "np_count", _r("np_depth"), "vp_count", "vp_depth")


@query('SELECT p_partkey, 2 AS "left", 0 AS "right", count(*) OVER (PARTITION BY p_size) AS alike FROM part')
def x33_trees(spark, sf):
    """Leaves beside the phrase within the verb phrase, and how many parts have a tree of the same shape."""
    rows = syntax.tree_places(_parses(spark, sf), "parse", (1, 1))
    return rows.join(rows.groupBy("shape").agg(F.count("*").alias("alike")), "shape").select("p_partkey", "left", "right", "alike")


@query()
def g21_arborescences(spark, sf):
    """Ten vectors after each other are the tokens of a sentence; unit tests hold the trees to small matrices."""
    rows = table(spark, sf, "embeddings").withColumn("sentence", F.floor(F.col("vec_id") / 10))
    return syntax.group_arborescences(rows, "sentence", "vec_id", "embedding")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS name, label FROM supplier LEFT JOIN embeddings ON vec_id = s_suppkey")
def l2_lookup(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), "label", "embedding")
    return metrics.lookup(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("name")), vectors).select("name", "label")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS word, CAST(row_number() OVER (ORDER BY CAST(s_suppkey AS VARCHAR)) - 1 AS INT) AS row, round(coalesce(CAST(embedding[1] AS DOUBLE), 0), 6) AS first, 64 AS size FROM supplier LEFT JOIN embeddings ON vec_id = s_suppkey + 450")
def l10_embedding_matrix(spark, sf):
    vectors = table(spark, sf, "embeddings").select((F.col("vec_id") - 450).cast("string").alias("word"), F.col("embedding").cast("array<double>").alias("vector"))
    m = metrics.embedding_matrix(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("word")), vectors, 64)
    return m.select("word", "row", F.round(F.col("vector")[0], 6).alias("first"), F.size("vector").alias("size"))


def _pooled(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), (F.col("l_orderkey") % 2).cast("int").alias("label"), F.col("l_suppkey").cast("string").alias("s"), F.col("l_linenumber").cast("string").alias("o"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("vector"))
    return learning.pooled_features(rows, vectors)


@query("""WITH s AS (SELECT l_orderkey AS path, CAST(l_suppkey AS BIGINT) AS s, CAST(l_linenumber AS BIGINT) AS o FROM lineitem), n AS (SELECT path, s AS name FROM s UNION SELECT path, o FROM s),
v AS (SELECT path, avg(CAST(embedding[1] AS DOUBLE)) AS x, avg(CAST(embedding[4] AS DOUBLE)) AS y FROM n JOIN embeddings ON vec_id = name GROUP BY path), k AS (SELECT path, count(*) AS edges FROM s GROUP BY path), m AS (SELECT path, count(*) AS nodes FROM n GROUP BY path)
SELECT CAST(path AS VARCHAR) AS path, CAST(path % 2 AS INT) AS label, round(x, 6) AS first, round(y, 6) AS fourth, round(ln(1 + nodes), 6) AS nodes, round(ln(1 + edges), 6) AS edges FROM k JOIN m USING (path) JOIN v USING (path)""")
def l3_pooled_features(spark, sf):
    f = F.col("features")
    return _pooled(spark, sf).select("path", "label", F.round(f[0], 6).alias("first"), F.round(f[3], 6).alias("fourth"), F.round(f[4], 6).alias("nodes"), F.round(f[5], 6).alias("edges"))


@query()
def l4_classifier(spark, sf):
    """Cross-validated fit on the pooled features; unit tests hold it to separable samples."""
    model, ready = learning.classifier(_pooled(spark, sf), folds=2)
    return model.transform(ready).select("path", "label", "prediction")


@query()
def l6_text_classifier(spark, sf):
    """Quality of the labelled texts from hashed words; unit tests hold it to separable texts."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    model, ready = learning.text_classifier(table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id"), folds=2)
    return model.transform(ready).select("doc_id", "label", "prediction")


@query("SELECT conv_id, turn, CASE WHEN text IS NULL THEN '' ELSE array_to_string(list_transform(range(len(string_split(text, ' '))), lambda i: CAST(CAST(i AS BIGINT) - 1 AS VARCHAR)), ',') END AS heads FROM conversations")
def l7_scored_trees(spark, sf):
    """With the default scores, each token hangs on the one before it."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("tokens"))
    return syntax.scored_trees(rows).select("conv_id", "turn", F.array_join(F.col("heads").cast("array<string>"), ",").alias("heads"))


@query(sql("SELECT CAST(entity AS VARCHAR) AS entity, round(neg / CAST(pos + neg AS DOUBLE), 6) AS pole FROM seen UNION ALL SELECT 'graph', round(avg((weight < 0)::INT), 6) FROM sag UNION ALL SELECT 'without 1', round(avg((weight < 0)::INT), 6) FROM sag WHERE e1 <> 1 AND e2 <> 1", "seen"))
def g11_scored(spark, sf):
    """A scorer (share of negative edges) plugged in for nodes, the graph, and the graph without a node."""
    e = t.sag_table(spark, sf)

    def share(n, rows):
        pos, neg = [0] * n, [0] * n
        for u, v, w in rows:
            for x in (u, v):
                pos[x] += w > 0
                neg[x] += w < 0
        return [b / (a + b) for a, b in zip(pos, neg)]

    whole = lambda n, rows: sum(w < 0 for _, _, w in rows) / len(rows)
    out = graph.node_scores(e, share).select(F.col("entity").cast("string").alias("entity"), _r("pole"))
    for name, without in (("graph", None), ("without 1", 1)):
        out = out.union(graph.graph_score(e, whole, without).select(F.lit(name).alias("entity"), _r("pole")))
    return out


@query("SELECT conv_id, turn, round(exp(len(text) / 100.0 - 2) / (1 + exp(1) + exp(len(text) / 100.0 - 2)), 6) AS positive, round(1 / (1 + exp(1) + exp(len(text) / 100.0 - 2)), 6) AS negative FROM conversations WHERE len(text) < 2000")
def l8_l9_attitudes(spark, sf):
    """A model that scores the length of a text, plugged in as any other."""
    rows = table(spark, sf, "conversations").filter("length(text) < 2000").select("conv_id", "turn", F.col("text").alias("masked"))
    out = learning.infer_attitudes(rows, lambda: lambda texts: [[0, 1, len(x) / 100 - 2] for x in texts])
    return out.select("conv_id", "turn", F.round("proba.positive", 6).alias("positive"), F.round("proba.negative", 6).alias("negative"))


@query(sql("SELECT e1, e2, n, round(total / CAST(n AS DOUBLE), 6) AS value FROM sums WHERE n >= 5 AND e1 IN (SELECT entity FROM fellows WHERE fid < 5)", "sums", "fellows"))
def u7_contained(spark, sf):
    """Pairs whose first entity is a member of the listed groups."""
    listed = t.groups(spark, sf).filter("fid < 5").select(F.col("entity").alias("e1")).distinct()
    return t.pair_sums(spark, sf).filter("n >= 5").join(listed, "e1", "left_semi").select("e1", "e2", "n", F.round(F.col("total") / F.col("n"), 6).alias("value"))


@query(sql("SELECT entity, count(*) AS n FROM et JOIN fellows USING (entity) GROUP BY entity", "et", "fellows"))
def g6_dipole_topics(spark, sf):
    """All entities' attitudes to topics; phrases that also occur as a surface form stay, and here all do."""
    surface = t.et(spark, sf).select(F.col("topic").alias("np")).distinct()
    from ..operators import topics

    return topics.surface_only(t.et(spark, sf).withColumnRenamed("topic", "np"), surface).join(t.groups(spark, sf), "entity").groupBy("entity").agg(F.count("*").alias("n"))


@query(sql("SELECT greatest(e1, e2) AS hi, least(e1, e2) AS lo, weight FROM sag", "sag"))
def s12_s13_edge_files(spark, sf):
    path = _folder(spark, "edges")
    readers.write_edge_list(t.sag(spark, sf), path, " ")
    hi = communities.edge_list(t.sag(spark, sf)).schema
    return spark.read.schema(hi).option("sep", " ").csv(path)
