"""Hand-computed cases of the library's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from schism.functions import numbers as N
from schism.functions import text as X
from schism.operators import attitudes, clustering, communities, entities, features, graph, knowledge_graph, metrics, moving, topics
from schism.sources import readers
from schism.sources.stages import new_rows, stage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def sag(spark, rows):
    return spark.createDataFrame(rows, "e1 string, e2 string, weight int")


@pytest.mark.parametrize("values,want", [([0.5, 0.5, -0.5, -0.5], 0.5), ([1, 1, 1, -1], 0.5), ([0.3], 0.0 * 0.3), ([], 0), ([0, 0], 0)])
def test_polarization(spark, values, want):
    pos, neg = [v for v in values if v > 0], [v for v in values if v < 0]
    mean = lambda v: F.lit(sum(v) / len(v)).cast("double") if v else F.lit(None).cast("double")
    assert math.isclose(one(spark, N.polarization(F.lit(len(pos)), F.lit(len(neg)), mean(pos), mean(neg))), want, abs_tol=1e-12)


def test_resampling(spark):
    obs = [("a", "t", 0.2)] * 2 + [("a", "t", -0.4)] + [("b", "t", 0.6)] * 5
    groups = spark.createDataFrame([(1, "a"), (2, "b")], "fid int, entity string")
    values = topics.side_values(spark.createDataFrame(obs, "entity string, topic string, v0 double"), groups, spark.createDataFrame([(1, 2)], "f1 int, f2 int"), "v0")
    row = topics.topic_polarization(values).first()
    n = {0.2: math.floor(5 * (2 / 3)), -0.4: math.floor(5 * (1 / 3))}
    assert n == {0.2: 3, -0.4: 1} and row.observations == 8
    pos, neg = (n[0.2] * 0.2 + 5 * 0.6) / (n[0.2] + 5), -0.4
    assert math.isclose(row.pi_res, (1 - abs(8 - 1) / 9) * (pos - neg) / 2)


@pytest.mark.parametrize("labels,want", [("RRDN", 0.5), ("NN", 0.0), ("RDDN", 0.5), ("D", 1.0)])
def test_purity(spark, labels, want):
    rows = spark.createDataFrame([(1, x) for x in labels], "fid int, label string")
    assert topics.purity(rows, ["fid"]).first().purity == want


def test_entity_mu(spark):
    assert one(spark, N.entity_mu(F.lit(3), F.lit(1))) == 0.5 and one(spark, N.entity_mu(F.lit(4), F.lit(0))) == 0 == one(spark, N.entity_mu(F.lit(0), F.lit(0)))


@pytest.mark.parametrize("value,want", [(-0.02, "NEUTRAL"), (0.02, "POSITIVE"), (1.0, "NEUTRAL"), (-1.0, "NEGATIVE"), (-0.021, "NEGATIVE")])
def test_sign_bins(spark, value, want):
    assert one(spark, N.sign_label(F.lit(value))) == want


def test_bins(spark):
    assert one(spark, N.bin_label(F.lit(1.0), [(0, 2, "a"), (1, 3, "b")])) == "a" and one(spark, N.bin_label(F.lit(1.0), [(0, 2, "a"), (1, 3, "b")], last=True)) == "b"
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert {r.bin: r.n for r in attitudes.histogram(df, "x").collect()} == {**{i: 1 for i in range(1, 10)}, 10: 2}
    assert {r.bin for r in attitudes.histogram(spark.createDataFrame([(2.0,)], "x double"), "x").collect()} == {6}
    labels = {r.x: r.label for r in topics.polarization_labels(df.withColumnRenamed("x", "pi").withColumn("x", F.col("pi"))).collect()}
    assert labels[10.0] == "Polarization0" and labels[0.0] == "Polarization1" and labels[9.5 // 1] == "Polarization10"


def test_probabilities(spark):
    df = spark.createDataFrame([((0.4, 0.2, 0.4),), ((0.3, 0.5, 0.2),), ((0.5, 0.2, 0.3),)], "proba struct<positive double, neutral double, negative double>")
    assert [r.attitude for r in attitudes.from_probabilities(df).collect()] == [-0.4, 0.0, 0.5]


def test_lexicon_polarity(spark):
    tokens = spark.createDataFrame([(1, "good", "good"), (1, "odd", "odd"), (1, "debate", "debate"), (2, "x", "x"), (3, "runs", "good")], "s int, text string, lemma string")
    lexicon = spark.createDataFrame([("good", "positive"), ("odd", "both"), ("debate", "negative")], "word string, polarity string")
    assert {r.s: round(r.polarity, 6) for r in attitudes.polarity(tokens, lexicon, ["s"], ("debate",)).collect()} == {1: 0.333333, 2: 0.0, 3: 1.0}
    paths = spark.createDataFrame([(1, 0.5), (1, 0.0), (1, -0.1), (2, 0.0)], "s int, polarity double")
    assert {r.s: round(r.attitude, 6) for r in attitudes.sentence_attitude(paths, ["s"]).collect()} == {1: 0.2, 2: 0.0}


def test_filters_and_pairs(spark):
    df = spark.createDataFrame([("a" * 513,), ("ok sentence",), ("  ab ",)], "sentence string")
    assert attitudes.within(df, least=5).count() == 1
    m = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "a", 3)], "sent int, entity string, pos int")
    assert sorted((r.e1, r.e2) for r in attitudes.entity_pairs(m, ["sent"], order="pos").collect()) == [("a", "b"), ("a", "b")]
    assert attitudes.entity_pairs(m.select("sent", "entity").distinct(), ["sent"]).count() == 1


@pytest.mark.parametrize("weights,bad", [((1, 1, -1), 1), ((1, -1, -1), 0)])
def test_frustration_triangle(spark, weights, bad):
    e = sag(spark, list(zip("aab", "bcc", weights))).withColumn("k", F.lit(1))
    r = communities.frustration(e, ["k"]).first()
    assert (r.frustrated, r.exact) == (bad, True) and math.isclose(r.f_g, 1 - 2 * bad / 3)
    balance = {r.kind: r.n for r in graph.triads(e).collect()}
    assert balance == {"+++": 0, "++-": int(bad == 1), "+--": int(bad == 0), "---": 0}


def test_frustration_search():
    """Local search reaches the exact value on small random graphs, and four in a ring with one negative edge cost one."""
    assert communities.frustration_count(4, np.array([0, 1, 2, 3]), np.array([1, 2, 3, 0]), np.array([1, 1, 1, -1])) == (1, True)
    r = np.random.default_rng(0)
    for n in (6, 9):
        i, j = np.triu_indices(n, 1)
        w = r.choice([-1, 1], len(i))
        exact, _ = communities.frustration_count(n, i, j, w)
        shown = communities.EXACT_NODES
        communities.EXACT_NODES = 2
        try:
            found, sure = communities.frustration_count(n, i, j, w)
        finally:
            communities.EXACT_NODES = shown
        assert not sure and exact <= found <= exact + 1


def test_signed_jaccard_and_closeness(spark):
    e = sag(spark, [("a", "b", 1)])
    assert graph.signed_jaccard(e).first().similarity == 1.0
    path = sag(spark, [("a", "b", 1), ("b", "c", -1)])
    assert {r.entity: r.closeness for r in graph.closeness(path).collect()} == {"a": 2 / 3, "b": 1.0, "c": 2 / 3}
    assert graph.closeness(path.limit(0)).count() == 0


def test_semantic_totals_equal_all_pairs(spark):
    r = np.random.default_rng(1)
    rows = [(f"n{i:02}", f"n{j:02}", int(r.choice([-1, 1]))) for i in range(15) for j in range(i + 1, 15) if r.random() < 0.35]
    adj = {}
    for a, b, _ in rows:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    n = len(adj)

    def distance(a, b):
        both, da, db = len(adj[a] & adj[b]), len(adj[a]), len(adj[b])
        down = math.log(n) - math.log(min(da, db))
        return (math.log(max(da, db)) - (math.log(both) if both else 0)) / down if down else 0.0

    got = {x.entity: x.semantic_association for x in graph.semantic_totals(sag(spark, rows)).collect()}
    for a in adj:
        assert math.isclose(got[a], sum(distance(a, b) for b in adj if b != a), abs_tol=1e-9)


def test_planted_communities(spark):
    rows = [(f"a{i}", f"a{j}", 1) for i in range(6) for j in range(i + 1, 6)] + [(f"b{i}", f"b{j}", 1) for i in range(5) for j in range(i + 1, 5)] + [(f"a{i}", f"b{i}", -1) for i in range(5)]
    runs = communities.cluster_runs(sag(spark, rows), runs=4)
    found = {}
    for r in communities.fellowships(runs, merge_iter=2).collect():
        found.setdefault(r.fid, set()).add(r.entity)
    assert found == {0: {f"a{i}" for i in range(6)}, 1: {f"b{i}" for i in range(5)}}
    groups = spark.createDataFrame([(f, e) for f, s in found.items() for e in s], "fid int, entity string")
    d = communities.dipoles(sag(spark, rows), groups).collect()
    assert [(r.f1, r.f2, r.pos, r.neg, r.negative_ratio, r.f_g) for r in d] == [(0, 1, 0, 5, 1.0, 1.0)]
    seeds = spark.createDataFrame([("a0", "R"), ("a1", "R"), ("a2", "R"), ("b0", "D"), ("b1", "D"), ("b2", "D")], "entity string, label string")
    labels = {r.entity: r.label for r in communities.propagate_labels(graph.signed_jaccard(sag(spark, rows)), seeds).collect()}
    assert labels["a3"] == "R" and labels["b3"] == "D"


def test_ward():
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert communities.ward(d, 0.5).tolist() == [0, 0, 1] and communities.ward(np.zeros((1, 1)), 0.5).tolist() == [0] and communities.consensus([], 1) == []


def test_closeness_of_a_long_path(spark):
    """Distances over the 30 that closeness once stopped at: the end of a path of 34 nodes reaches all of them."""
    path = spark.createDataFrame([(i, i + 1, 1) for i in range(33)], "e1 long, e2 long, weight long")
    got = {r.entity: r.closeness for r in graph.closeness(path).collect()}
    assert math.isclose(got[0], 33 / sum(range(34))) and math.isclose(got[33], got[0])


def test_comembership(spark):
    """x is with a, b, c in two runs of four and with d, e, f in the other two; g is alone in one of them."""
    runs = [["abcx", "def"], ["abcx", "def"], ["abc", "defx"], ["abc", "defx", "g"]]
    rows = [(r, c, e) for r, communities_ in enumerate(runs) for c, members in enumerate(communities_) for e in members]
    out = communities.comembership(spark.createDataFrame(rows, "run int, community int, entity string")).collect()
    assert {r.entity: r.frequency for r in out} == {**dict.fromkeys("abcdef", 4), "x": 2, "g": 1}
    assert communities.comembership(spark.createDataFrame([], "run int, community int, entity string")).count() == 0


def test_topic_rank(spark):
    df = spark.createDataFrame([("t", 4, 0.2), ("t", 6, 0.4)], "topic string, observations long, pi double")
    r = topics.rank_topics(df).first()
    assert (r.dt, r.obst) == (2, 10) and math.isclose(r.mt, 0.3) and math.isclose(r.score, 1.5) and math.isclose(r.std_pi, 0.1)
    assert topics.topic_score(df, "none").first().score == 0.0


def test_text(spark):
    assert one(spark, X.preprocess(F.lit("I don’t think “they’re” — won't\ncan't"))) == "I do not think \"they are\" - will not can not"
    assert one(spark, X.clean_phrase(F.lit("The well-known 2023 U.S. report, of"))) == "wellknown u s report"
    assert one(spark, X.phrase_has_content(F.lit("of the ,"))) is False
    assert one(spark, X.title_slug(F.lit("Hello, World  again"))) == "hello-world-again"
    assert one(spark, X.url_host(F.lit("http://me@a.b:80/p?q"))) == "me@a.b:80" and one(spark, X.url_host(F.lit(None).cast("string"))) == ""
    assert one(spark, X.ngrams(F.array(*map(F.lit, "abcd")), 3)) == ["a b c", "b c d"] and one(spark, X.ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, X.wiki_links(F.lit("x [[A|b]] y [[C]]"))) == ["A", "b", "C"]
    spans = F.array(F.struct(F.lit(0).alias("begin"), F.lit(2).alias("end")), F.struct(F.lit(5).alias("begin"), F.lit(8).alias("end")))
    assert one(spark, X.replace_spans(F.lit("ab cdefg!"), spans, lambda s: F.lit("[E]"))) == "[E] cd[E]!"
    first = one(spark, X.first_span(F.lit("one two"), "two"))
    assert (first.begin, first.end) == (4, 7) and one(spark, X.first_span(F.lit("one"), "two")) is None
    assert one(spark, X.keyword_count(F.lit("/a-vote-vote"), ["vote", "a"])) == 3


def test_entities(spark):
    e = F.array(*(F.struct(F.lit(t).alias("title"), F.lit(t).alias("dbpedia")) for t in "abc"))
    out = one(spark, entities.transform_entities(e, [{"replace": {"a": "z"}}, {"delete": ["b"]}]))
    assert [x.title for x in out] == ["z", "c"] and out[0].dbpedia == "z"
    articles = spark.createDataFrame([("u", "Ann came. She left. Ann"), ("v", "none")], "uid string, text string")
    clusters = spark.createDataFrame([("u", 1, 0, 3), ("u", 1, 10, 13)], "uid string, cluster int, begin int, end int")
    assert {r.uid: r.text for r in entities.resolve_coreference(articles, clusters).collect()} == {"u": "Ann came. Ann left. Ann", "v": "none"}
    found = entities.propagate_entities(spark.createDataFrame([("u", 1, 3, "Ann")], "uid string, begin int, end int, title string"), clusters)
    assert {(r.begin, r.end) for r in found.collect()} == {(1, 3), (0, 3), (10, 13)}


def test_moving(spark):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "key string, pos int, value double")
    args = (df, ["key"], ["pos"], "value")
    get = lambda d, c: [r[c] for r in d.orderBy("pos").collect()]
    assert get(moving.simple(*args, 2), "sma") == [1, 1.5, 2.5, 3.5] and get(moving.simple(*args, 2, empty=0, partial=False), "sma") == [0, 1.5, 2.5, 3.5]
    assert get(moving.cumulative(*args), "cma") == [1, 1.5, 2, 2.5] and get(moving.exponential(*args, 0.5), "ema") == [1, 1.5, 2.25, 3.125]
    assert get(moving.weighted(*args, 2), "wma") == [1, (1 + 4) / 3, (2 + 6) / 3, (3 + 8) / 3] and moving.days(7) == 0.25


def test_clusters(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.9, 0.0]), (4, [0.0, 1.0]), (5, [0.1, 1.0]), (6, [-1.0, -1.0])], "vec_id long, embedding array<float>")
    pairs = clustering.similar_pairs(v, 0.9, block=2)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (1, 3), (2, 3), (4, 5)}
    taken = clustering.take_clusters(pairs, 2).collect()
    assert {(r.head, r.member) for r in taken} == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)}
    found = {r.vec_id: r.head for r in clustering.online_clusters(v, 0.9, 0.8, 2).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_graph_assembly(spark):
    e = sag(spark, [("a", "b", -1)])
    et = spark.createDataFrame([("a", "t", 0.5, 3, "POSITIVE")], "entity string, topic string, weight double, observations long, label string")
    groups = spark.createDataFrame([(0, "a"), (1, "b")], "fid int, entity string")
    gt = spark.createDataFrame([(0, "t", 0.5, 3, "POSITIVE")], "fid int, topic string, weight double, observations long, label string")
    d = spark.createDataFrame([(0, 1, 0, 1, 1.0)], "f1 int, f2 int, pos long, neg long, f_g double")
    dt = spark.createDataFrame([(0, 1, "t", 0.4, 5, "Polarization0")], "f1 int, f2 int, topic string, pi double, observations long, label string")
    g = knowledge_graph.assemble(e, et, groups, gt, d, dt)
    assert g.count() == 10 and {r.id: r.type for r in knowledge_graph.nodes(g).collect()} == {"a": "Entity", "b": "Entity", "T:t": "Topic", "F0": "Fellowship", "F1": "Fellowship", "D0_1": "Dipole"}
    assert {r.neighbour for r in knowledge_graph.neighbours(g, knowledge_graph.nodes(g), "Fellowship").filter("node = 'D0_1'").collect()} == {"F0", "F1"}
    assert knowledge_graph.conflicts(g).first().frustration == 1.0 and knowledge_graph.polarization_edges(g).first().pi == 0.4 and knowledge_graph.members(g).count() == 2
    assert knowledge_graph.triples(g).filter("predicate = 'MEMBEROF'").count() == 2 and knowledge_graph.attitudes(g).count() == 4


def test_features(spark):
    assert features.prune_subsequences([[1, 3], [1, 2, 3], [4], [3, 1]]) == [[1, 2, 3], [3, 1], [4]]
    docs = spark.createDataFrame([(1, "a a b c"), (2, "")], "doc_id int, text string")
    v = {r.doc_id: r for r in features.vocabulary_richness(docs).collect()}
    assert (v[1].vr_hapax, v[1].vr_dis_hapax, v[1].vr_ttr, v[1].vr_yule) == (2, 2, 0.75, 9 / 3) and v[2].vr_hapax == 0 == v[2].vr_brunet
    m = metrics.binary_metrics(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "t int, p int"), "t", "p").first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.5, 0.5, 0.5, 0.5)


def test_sources(spark, tmp_path):
    import gzip
    import json

    (tmp_path / "gdelt.csv").write_text("\t".join([*(["1", "20231116"] + [""] * 55), "http://a.b/vote-x"]) + "\n")
    row = readers.gdelt(spark, str(tmp_path / "gdelt.csv")).first()
    assert len(row) == 58 and row.day == "20231116" and row.sourceurl == "http://a.b/vote-x"
    assert readers.select_articles(readers.gdelt(spark, str(tmp_path / "gdelt.csv")), ["vote"], ["a.b"]).first().n_keywords == 1
    a = {"url": "u", "uid": "1", "images": ["i"], "publication-date": "2023-11-16", "text": "t \"q\"", "title": "T", "top-image": "i"}
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "1.json").write_text(json.dumps(a))
    (tmp_path / "x" / "y" / "2.json").write_text(json.dumps(json.dumps(a | {"uid": "2"})))
    assert sorted((r.uid, r.text, r.images) for r in readers.articles(spark, str(tmp_path / "x")).collect()) == [("1", 't "q"', ["i"]), ("2", 't "q"', ["i"])]
    page = spark.createDataFrame([(1, "<html><head><title>T</title><meta name='date' content='2023-01-02T3'></head><body><nav>menu</nav><p>A&amp;b</p><img src='i.png'><script>x</script><p>c</p></body></html>"), (2, None)], "page_id int, html string")
    p = {r.page_id: r for r in readers.parse_html(page, "2023-11-16").collect()}
    assert (p[1].title, p[1].text, p[1].images, str(p[1].publication_date)) == ("T", "A&b\nc", ["i.png"], "2023-01-02") and str(p[2].publication_date) == "2023-11-16"
    (tmp_path / "lex").write_text("type=weak len=1 word1=good pos1=adj junk priorpolarity=neutral\ntype=s len=1 word1=good priorpolarity=positive\n")
    assert [(r.word, r.polarity) for r in readers.subjectivity_lexicon(spark, str(tmp_path / "lex")).collect()] == [("good", "positive")]
    assert readers.category_dictionary(["%", "1\tanger", "%", "hat* 1", "x 9"]) == [("hat*", "anger")]
    assert readers.nested_lexicon({"A": {"B": ["x"], "C": "y"}}) == [("a_b", "x"), ("a_c", "y")]
    (tmp_path / "words").write_text("# c\nOne\n\n two \na,b\n")
    assert {r.term for r in readers.word_list(spark, str(tmp_path / "words"), sep=",").collect()} == {"one", "two"}
    (tmp_path / "afinn").write_text("bad\t-3\nbad\t-2\n")
    assert readers.weighted_list(spark, str(tmp_path / "afinn")).first().score == -2
    (tmp_path / "nrc").write_text("w\tjoy\t1\nw\tfear\t0\n")
    assert [(r.term, r.category) for r in readers.emotion_table(spark, str(tmp_path / "nrc")).collect()] == [("w", "joy")]
    with gzip.open(tmp_path / "topics.json.gz", "wt") as f:
        json.dump({"t0": {"noun_phrases": ["A", "B"], "pre_processed": ["a", "b"], "similarity_scores": [1.0, 0.9]}}, f)
    assert [(r.topic_id, r.pos, r.np, r.clean_np) for r in readers.topics(spark, str(tmp_path / "topics.json.gz")).collect()] == [("t0", 0, "A", "a"), ("t0", 1, "B", "b")]
    readers.write_fellowships(spark.createDataFrame([(0, "b"), (0, "a")], "fid int, entity string"), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).first().members == ["a", "b"]
    readers.write_edge_list(sag(spark, [("a", "b", -1)]), str(tmp_path / "e"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "e")).first()[:] == ("b", "a", "-1")


def test_annotators(spark):
    articles = spark.createDataFrame([("u", "Ann Lee met Bob.  He left!\nNew line")], "uid string, text string")
    s = readers.sentences(articles)
    text = articles.first().text
    rows = s.orderBy("sent_ix").collect()
    assert [r.sentence for r in rows] == ["Ann Lee met Bob.", "He left!", "New line"] and all(text[r["from"] : r["to"]] == r.sentence for r in rows)
    names = spark.createDataFrame([("Ann Lee", "A"), ("Bob", "B")], "name string, title string")
    assert {(r.title, r.begin, r.end) for r in readers.gazetteer_entities(s, names).collect()} == {("A", 0, 7), ("B", 12, 15)}
    assert "New line" in {r.ngram for r in readers.noun_phrases(s).collect()}


def test_stages(spark):
    df = spark.createDataFrame([("a",), ("b",)], "uid string")
    assert stage(df, "t").count() == 2 and [r.uid for r in new_rows(df, df.limit(1)).collect()] == ["b"]


def test_streams(spark, tmp_path):
    from schism.streaming.attitudes import exponential_average, windowed_means

    rows = spark.createDataFrame([("k", "2023-01-01 00:01:00", 1.0), ("k", "2023-01-01 00:02:00", 3.0), ("k", "2023-01-01 05:00:00", 5.0)], "key string, t string, value double").select("key", F.to_timestamp("t").alias("ts"), "value")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for i, df in enumerate((windowed_means(source, ["key"], "value"), exponential_average(source, "key", "value", 0.5))):
        q = df.writeStream.outputMode("update").format("memory").queryName(f"s{i}").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c{i}").start()
        q.awaitTermination()
    assert {(r.n, r["mean"]) for r in spark.table("s0").collect()} == {(2, 2.0), (1, 5.0)} and spark.table("s1").first().ema == 3.5
