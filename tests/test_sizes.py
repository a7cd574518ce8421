"""Steps whose memory, shuffle or time must not grow faster than their input, and results on odd rows."""

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from schism.functions import batches
from schism.functions import text as X
from schism.llm import common, language_model
from schism.operators import syntax
from schism.sources import readers


def wide_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def narrow(spark):
    return int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= batches.BATCH_ROWS


def test_pieces():
    texts = pa.array(["ab", None, "c" * 9, "", "dd", "e"])
    for column in (texts, texts.slice(1), pa.array([None if t is None else list(t) for t in texts.to_pylist()])):
        got = list(batches.pieces(column, 4))
        assert [i for a, b in got for i in range(a, b)] == list(range(len(column)))
        sizes = [[len(t or "") for t in column.slice(a, b - a).to_pylist()] for a, b in got]
        assert all(sum(s) <= 4 or len(s) == 1 for s in sizes)
    kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.int32())]))
    assert batches.structs([[("x", 1), ("y",)], [], [("z", 2)]], kind).to_pylist() == [[{"a": "x", "b": 1}, {"a": "y", "b": None}], [], [{"a": "z", "b": 2}]]
    assert batches.structs([[], []], kind).to_pylist() == [[], []]


def test_parsed_in_pieces(spark):
    """tokens of a few texts at a time, whatever the rows of a task; the same tokens and paths as text by text."""
    wide_batches(spark)
    texts = ["The dog, it barked.", "", None, "one", "x " * 3_000] * 3
    parsed = syntax.parse(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), column="text")
    assert narrow(spark)
    names = ("text", "lemma", "pos", "head", "dep")
    for r in parsed.collect():
        assert [tuple(t[n] for n in names) for t in r.tokens] == syntax.chain_parser(texts[r.i])
    wide_batches(spark)
    ends = parsed.filter(F.size("tokens").between(2, 20)).withColumns({"source": F.array(F.lit(0)), "target": F.array(F.size("tokens") - 1)})
    found = syntax.attitude_paths(ends).collect()
    assert narrow(spark) and [r.paths for r in found] == [[["dog", ",", "barked"]]] * 3


def test_ngram_spans_of_many_rows(spark):
    """pieces of texts in a batch keep their rows, empty ones among them."""
    texts = [None if i % 5 == 0 else "" if i % 5 == 1 else f"dog {i} cat " * (i * 300) for i in range(12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    for r in rows.select("i", X.ngram_spans("text", 2).alias("g")).collect():
        at = [m.span() for m in re.finditer(r"\w+", texts[r.i] or "")]
        assert [(g["from"], g["to"]) for g in r.g] == [(a[0], b[1]) for a, b in zip(at, at[1:])]
    assert np.all([len(r.g) == 0 for r in rows.filter("text is null").select(X.ngram_spans("text", 2).alias("g")).collect()])


def test_spans_behind_the_end(spark):
    """a text that ends before or within a span, as DuckDB cuts it; a replacement isn't cut again."""
    spans = F.array(*(F.struct(F.lit(b).alias("begin"), F.lit(e).alias("end"), F.lit(by).alias("by")) for b, e, by in ((0, 3, "[SOURCE]"), (8, 11, "[TARGET]"))))
    texts = ["", "a", "ab", "abc", "abcdefgh", "abcdefghij", "abcdefghijklm", "äöü日本x y z 12", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.replace_spans("t", spans, lambda s: s["by"]).alias("m"))
    assert {r.t: r.m for r in rows.collect()} == {t: None if t is None else "[SOURCE]" + t[3:8] + "[TARGET]" + t[11:] for t in texts}


def test_gazetteer_rows_are_not_broadcast(spark):
    """small sentences on disk against names of unknown size: the names are the broadcast side."""
    from schism.sources import readers
    from schism.sources.stages import stage

    rows = stage(spark.createDataFrame([("u", 0, "the house of data"), ("v", 1, "time")], "uid string, sent_ix int, sentence string"), "few")
    found = readers.gazetteer_entities(rows, spark.createDataFrame([("the house", "House"), ("time", "Time")], "name string, title string"))
    assert {(r.uid, r.title, r.begin, r.end) for r in found.collect()} == {("u", "House", 0, 9), ("v", "Time", 0, 4)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "hint" not in plan
    assert "BroadcastHashJoin" not in rows.join(readers._never_the_left(rows, 1), "uid")._jdf.queryExecution().sparkPlan().toString()


def test_complexity_in_one_pass():
    """equal to the tree's, brackets as labels and single words among them, and no recursion."""
    rng = np.random.default_rng(1)

    def some(depth):
        if depth == 0 or rng.random() < 0.2:
            return "w"
        first = some(depth - 1) if rng.random() < 0.1 else str(rng.choice(["NP", "VP", "S"]))
        return f"({' '.join([first, *(some(depth - 1) for _ in range(rng.integers(0, 4)))])})"

    for text in [some(5) for _ in range(300)] + ["w", "(NP)", "(S (NP x)) (VP y)", "x (NP y)"]:
        tree = syntax.read_tree(text)
        assert syntax.measured(text) == (len(syntax.leaves(tree)), syntax.complexity(tree)), text
    deep = 5_000
    assert syntax.measured("(NP " * deep + "x" + ")" * deep) == (1, {"depth": float(deep), "np_count": float(deep), "np_depth": (deep + 1) / 2, "vp_count": 0.0, "vp_depth": 0.0})


def test_consensus_of_many_communities(monkeypatch):
    """over as many communities as one matrix holds, the clusters are those of the whole matrix; with and without matrices of the parts."""
    from schism.operators import communities

    rng = np.random.default_rng(5)

    def drawn(size, wide):
        base = [set(map(int, rng.choice(np.arange(wide * p, wide * p + wide), rng.integers(*size), replace=False))) for p in range(4) for _ in range(4)]
        return [{e for e in base[rng.integers(len(base))] if rng.random() < 0.85} | set(map(int, rng.integers(0, 4 * wide, size[0] // 3))) for _ in range(90)]

    split = lambda label: {tuple(np.flatnonzero(label == c)) for c in set(label.tolist())}
    for _ in range(15):
        sets, large = drawn((3, 12), 40), drawn((100, 300), 900)  # distances of the large ones are all different
        for cut in (0.25, 0.5, 0.7):
            assert communities.ward_sets(sets, cut).tolist() == communities.ward(communities._jaccard_distance(sets), cut).tolist()
            want = split(communities.ward(communities._jaccard_distance(large), cut))
            assert split(communities._ward_of_shared(large, cut)) == want
        assert 16 <= len(want) < 90
    runs = [{f"{p}-{e}" for e in range(5)} for p in range(1_100) for _ in range(5)]
    assert len(communities.consensus(runs, 3)) == 1_100 and set(communities.cluster_frequencies(runs)[1].values()) == {5}
    monkeypatch.setattr(communities, "MAX_COMMUNITIES", 2)
    assert len(communities.consensus(runs[:200], 3)) == 40


def test_pooled_features_of_odd_samples(spark):
    """the numbers of a loop over the nodes: repeated edges, self loops, names without, with several, and with shorter vectors."""
    from schism.operators import learning

    rows = [("p", 1, "a", "b"), ("p", 1, "a", "b"), ("p", 1, "c", "c"), ("q", 0, "x", "y"), ("r", 1, "d", "x"), ("r", 1, None, "a"), (None, 0, "a", "b")]
    known = [("a", [1.0, 2.0]), ("b", [3.0, 5.0]), ("c", [4.0]), ("d", [0.5, 1.5]), ("d", [1.5, 2.5]), ("z", [9.0, 9.0, 9.0])]
    samples = spark.createDataFrame(rows, "path string, label int, s string, o string")
    want = {}
    for path in ("p", "q", "r"):
        own = [r for r in rows if r[0] == path]
        nodes = {x for r in own for x in r[2:]}
        vectors = [v for n, v in known if n in nodes]
        if vectors:
            mean = [np.mean([v[i] for v in vectors if len(v) > i]) for i in range(max(map(len, vectors)))]
            want[path] = (max(r[1] for r in own), [*mean, np.log1p(len(nodes)), np.log1p(len(own))])
    for broadcast in (4_000_000, 0):
        learning.BROADCAST_NUMBERS = broadcast
        found = learning.pooled_features(samples, spark.createDataFrame(known, "name string, vector array<double>"))
        got = {r.path: (r.label, r.features) for r in found.collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1]) for k in want)
    learning.BROADCAST_NUMBERS = 4_000_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1  # samples are read and dealt once


def test_classifier_reads_a_stage(spark):
    """rows of a fit come from a table, not from a plan that each pass works out again."""
    from schism.operators import learning

    rows = spark.createDataFrame([([float(i % 2), 1.0], i % 2) for i in range(40)], "features array<double>, label int")
    model, ready = learning.classifier(rows.repartition(3).distinct().union(rows), folds=2)
    assert len(ready.inputFiles()) > 0 and "Aggregate" not in ready._jdf.queryExecution().optimizedPlan().toString()


def test_similar_vectors_in_few_blocks(spark):
    """A row is sent to a bounded number of blocks, whatever their rows; the pairs are those of one product."""
    from schism.operators import clustering

    m = np.random.default_rng(3).normal(size=(150, 4))
    m[7] = 0
    pairs = clustering.similar_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>"), 0.5, block=4)
    assert f"sequence(0, {clustering.BLOCKS - 1}" in pairs._jdf.queryExecution().analyzed().toString()
    with np.errstate(invalid="ignore"):
        c = m @ m.T / np.sqrt((m * m).sum(1))[:, None] / np.sqrt((m * m).sum(1))[None]
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert got.keys() == {(i, j) for i in range(150) for j in range(i + 1, 150) if c[i, j] >= 0.5} and all(np.isclose(c[k], v) for k, v in got.items())


def test_pairs_of_clusters_are_found_once(spark):
    """The pairs behind clusters are worked out a single time."""
    from schism.operators import clustering

    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.7)], "a long, b long, similarity double").mapInPandas(run, "a long, b long, similarity double")
    assert {r.member for r in clustering.take_clusters(rows).collect()} == {1, 2, 3} and seen.value == 3


def test_multiplicity_is_dealt_by_sentence(spark):
    """mentions are dealt once, into parts by their size, and counted and paired there; parts follow the bytes read."""
    from schism.plans.queries import QUERIES
    from schism.sources.stages import parts

    plan = QUERIES["j5_multiplicity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [sent") == 2  # the same on both sides of the pairs
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts(rows) == least and parts(rows, 1_000) > 10 * least and parts(rows.union(rows), 1_000) > 1.9 * parts(rows, 1_000)


def test_histogram_of_a_single_value(spark, tmp_path):
    """F8: few pairs are often seen in large tables with many entities; means of one value lie in the bin that the SQL gives."""
    import duckdb

    from schism.plans.queries import ORACLES, QUERIES

    for case, tone in {"one": "0.0", "many": "l_orderkey / 100"}.items():
        (tmp_path / case).mkdir()
        lines = f"SELECT l_orderkey, l_linenumber, l_linenumber + 2 * (l_orderkey // 5) AS l_suppkey, l_linenumber AS l_partkey, CAST({tone} AS DOUBLE) AS l_discount"
        duckdb.execute(f"COPY ({lines} FROM range(10) o(l_orderkey), range(2) l(l_linenumber)) TO '{tmp_path}/{case}/lineitem.parquet'")
        with duckdb.connect() as c:
            c.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/{case}/lineitem.parquet'")
            want = sorted(c.execute(ORACLES["a6_a7_histogram"]).fetchall())
        assert sorted(map(tuple, QUERIES["a6_a7_histogram"](spark, str(tmp_path / case)).collect())) == want
        assert len(want) == {"one": 1, "many": 2}[case]


def _joins(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]


def test_article_graphs_meet_edges_by_both_ends(spark):
    """an article's nodes never meet all edges of its entities; self loops and edges out of topics are found, own ones not twice."""
    from schism.operators import knowledge_graph

    ee = spark.createDataFrame([(1, 10, 20, 3), (1, 10, 20, 5), (1, 20, 30, -2), (2, 10, 30, 1), (None, 10, 20, 1)], "uid int, e1 int, e2 int, num int")
    et = spark.createDataFrame([(1, 10, "x", 4), (2, 30, "y", 2), (3, 20, "x", 1)], "uid int, entity int, topic string, num int")
    known = [("10", "20"), ("20", "10"), ("10", "30"), ("20", "T:x"), ("10", "T:x"), ("10", "T:y"), ("T:x", "10"), ("20", "20"), ("10", "F1"), ("40", "10"), *(("10", f"T:{i}") for i in range(50))]
    own = {(1, "10", "20"): 4.0, (1, "20", "30"): -2.0, (2, "10", "30"): 1.0, (None, "10", "20"): 1.0, (1, "10", "T:x"): 4.0, (2, "30", "T:y"): 2.0, (3, "20", "T:x"): 1.0}
    for edges in (known, [e for e in known if not e[0].startswith("T:") and e[0] != e[1]]):
        df = spark.createDataFrame([(*e, "Attitude", "L", 9.0) for e in edges], "src string, dst string, type string, label string, weight double")
        nodes = {u: {n for k in own if k[0] == u for n in k[1:]} for u in (1, 2, 3)}
        want = own | {(u, *e): 9.0 for u, ns in nodes.items() for e in edges if set(e) <= ns and (u, *e) not in own}
        got = knowledge_graph.article_graphs(ee, et, df)
        rows = [((r.uid, r.src, r.dst), r.weight) for r in got.collect()]
        assert len(rows) == len(want) and dict(rows) == want
        assert all(line.count("src") == 2 == line.count("dst") for line in _joins(got)) and len(_joins(got)) == 1


def test_article_groups_without_a_graph(spark):
    """an article's nodes are those of its own pairs and topics; its dipoles are found from lists of fellowships."""
    from schism.operators import knowledge_graph

    ee, et = spark.createDataFrame([(1, 10, 20, 3), (1, 20, 30, 1)], "uid int, e1 int, e2 int, num int"), spark.createDataFrame([(1, 10, "x", 4), (2, 40, "x", 1)], "uid int, entity int, topic string, num int")
    nodes = knowledge_graph.article_nodes(ee, et)
    assert sorted(map(tuple, nodes.collect())) == [(1, "10"), (1, "20"), (1, "30"), (1, "T:x"), (2, "40"), (2, "T:x")]
    fellowships = {1: [1, 2, 3, 12], 2: [1, 4], 3: [2], 4: [2, 3, 3, 4]}
    dipoles = [(1, 2), (1, 3), (2, 3), (1, 12), *((2, i) for i in range(20, 60))]
    edges = spark.createDataFrame([(f"F{f}", f"D{a}_{b}", "PartOf") for a, b in dipoles for f in (a, b)], "src string, dst string, type string")
    found = knowledge_graph.article_dipoles(spark.createDataFrame([(u, f"F{f}") for u, fs in fellowships.items() for f in fs], "uid int, fellowship string"), edges)
    assert sorted(map(tuple, found.collect())) == sorted((u, f"D{a}_{b}") for u, fs in fellowships.items() for a, b in dipoles if a in fs and b in fs)
    assert not any("Expand" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_terms_counted_in_pieces(spark):
    """terms of a bounded piece of text at a time, by the white space and characters of Spark's own functions."""
    from schism.operators import features

    texts = [None, "", " The the\u00a0x\tthe\x0bİ \x1cB\u2003c ", "a b a b a", "x" * 40_000 + " y", "!😀?? !"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    wide_batches(spark)
    got = {(r.doc_id, r.word): (r.k, r.words) for r in features._with_size(docs, "doc_id").collect()}
    assert narrow(spark)
    lists = {r.doc_id: list(r.w) for r in docs.select("doc_id", X.words(F.lower("text")).alias("w")).collect()}
    assert got == {(i, w): (ws.count(w), len(ws)) for i, ws in lists.items() for w in ws}
    assert "HigherOrder" not in (plan := features.word_counts(docs)._jdf.queryExecution().executedPlan().toString()) and "array_sort" not in plan
    grams = docs.filter("doc_id in (3, 5)").select("doc_id", features.counted("text", (1, 2)).alias("w"), features.counted("text", (2, 3), "char").alias("c"))
    got = {r.doc_id: ({g.word: g.k for g in r.w}, {g.word: g.k for g in r.c}) for r in grams.collect()}
    assert got[3][0] == {"a": 3, "b": 2, "a b": 2, "b a": 2} and got[5][1] == {"!😀": 1, "😀?": 1, "??": 1, "?": 1, "!": 1, "!😀?": 1, "😀??": 1, "?? !"[:2]: 1, "?!": 1} | {"??": 2}


def test_patterns_meet_short_heads(spark):
    """a token meets patterns by heads no longer than the longest of them."""
    from schism.operators import features

    patterns = spark.createDataFrame([("th*", "a"), ("ab", "b")], "pattern string, category string")
    docs = spark.createDataFrame([(1, "th" + "x" * 100_000 + " ab abc " + "y" * 100_000), (2, None)], "doc_id int, text string")
    assert sorted(map(tuple, features.pattern_categories(docs, patterns).collect())) == [(1, "a", 25.0), (1, "b", 25.0)]


def test_tensors_are_dealt_by_path_once(spark):
    """nodes, pairs and labels come from one deal by path; odd rows give what a loop gives."""
    from schism.operators import knowledge_graph

    rows = [("p", 1, "b", "a"), ("p", 1, "b", "a"), ("p", 1, "c", "c"), ("p", 1, "a", "c"), ("q", 0, "z", "z"), (None, 1, "a", "b"), ("r", 1, None, "a"), ("r", 1, "a", "B")]
    got = knowledge_graph.tensors(spark.createDataFrame(rows, "path string, label int, s string, o string"), size=2)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found = {r.path: (r.label, r.nodes, [tuple(e) for e in r.edge_index or []] if r.edge_index is not None else None, r.x) for r in got.collect()}
    assert found == {"p": (1, ["a", "b", "c"], [(0, 2), (1, 0)], [[0.0, 0.0]] * 3), "q": (0, ["z"], None, [[0.0, 0.0]]), "r": (1, [None, "B", "a"], [(2, 1)], [[0.0, 0.0]] * 3)}
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "name string, vector array<float>")
    assert {r.path: r.x for r in knowledge_graph.tensors(spark.createDataFrame(rows[:5], "path string, label int, s string, o string"), vectors, 2).collect()} == {"p": [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]], "q": [[0.0, 0.0]]}


def test_sentences_of_long_texts(spark):
    """a sentence's place is its own behind a blank line too, and costs the same anywhere in a text."""
    texts = ["One. Two.\n  \nOne. \n\n  é 𝒳! x", None, "", " \n", "\tNo. 5 is it.  \nU.S. law? yes", "Same words again. " * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "uid int, text string").repartition(1)
    wide_batches(spark)
    got = readers.sentences(rows)
    assert narrow(spark) and got.dtypes == [("uid", "int"), ("sent_ix", "int"), ("sentence", "string"), ("from", "int"), ("to", "int")]
    found = {}
    for r in got.orderBy("uid", "sent_ix").collect():
        found.setdefault(r.uid, []).append((r.sent_ix, r.sentence, r["from"], r["to"]))
    assert all(texts[uid][a:b] == s for uid, own in found.items() for _, s, a, b in own)
    assert found[0] == [(0, "One.", 0, 4), (1, "Two.", 5, 9), (2, "One.", 13, 17), (3, "é 𝒳!", 22, 26), (4, "x", 27, 28)]
    assert [s for _, s, _, _ in found[4]] == ["\tNo. 5 is it.", "U.S. law?", "yes"]
    assert [(a, b) for _, _, a, b in found[5]] == [(18 * i, 18 * i + 17) for i in range(20_000)] and set(found) == {0, 4, 5}


def test_stage_without_checksum_files(spark):
    """op1: a stage in a local folder is its Parquet files alone, so one process less is started for each, and for each file's permission."""
    df = spark.range(100, numPartitions=3).select("id", F.col("id").cast("string").alias("s"))
    staged = common.stage(df, "plain", **{"parquet.block.size": 1 << 20})
    files = [f for _, _, names in os.walk(staged._staged_path.removeprefix("file://")) for f in names]
    assert sum(f.endswith(".parquet") for f in files) == 3 and not any(f.endswith(".crc") for f in files)
    assert staged.columns == df.columns and sorted(staged.collect()) == sorted(df.collect())
    common.drop_stage(staged)
    assert not common.exists(spark, staged._staged_path)


def test_small_reads(spark):
    """op1: few blocks at once become columns; a smaller bound stays."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    try:
        for most, expected in (("4096", common.READ_ROWS), ("16", 16)):
            spark.conf.set(key, most)
            language_model._Model(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 7, 2, 200.0, 4.0, 1000)
            assert int(spark.conf.get(key)) == expected
    finally:
        spark.conf.set(key, before)
