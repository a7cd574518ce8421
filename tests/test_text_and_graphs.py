"""Operators that SQL can't check, against brute force on small cases."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from schism.functions import text as X
from schism.operators import affect, clustering, features, graph, knowledge_graph, metrics, syntax
from schism.sources import annotators, readers


def test_ngram_spans(spark):
    texts = ["The dog, the cat.", "of the", "...", "", None, "naïve café 日本 x", "a_b -- c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for n in (1, 2, 3):
        got = {r.i: [tuple(g) for g in r.g] for r in rows.select("i", X.ngram_spans("text", n).alias("g")).collect()}
        for i, text in enumerate(texts):
            tokens = list(re.finditer(r"\w+|[^\w\s]", text or ""))
            want = []
            for k in range(len(tokens) - n + 1):
                own = [t.group() for t in tokens[k : k + n]]
                if any(re.match(r"\w", w) for w in own) and any(w not in X.STOP_WORDS for w in own):
                    want.append((text[tokens[k].start() : tokens[k + n - 1].end()], tokens[k].start(), tokens[k + n - 1].end()))
            assert got[i] == want


def test_sentences_and_abbreviations(spark):
    rows = spark.createDataFrame([("u", 'Mr. Smith met J. Doe at 5 p.m. in the U.S. embassy. "Why?" he said.\nNew line')], "uid string, text string")
    assert [r.sentence for r in readers.sentences(rows).orderBy("sent_ix").collect()] == ["Mr. Smith met J. Doe at 5 p.m. in the U.S. embassy.", '"Why?"', "he said.", "New line"]


def test_quotes_and_contractions(spark):
    rows = spark.createDataFrame([("There's a `tick`, ``two``, they’re – y'all won't, can't; shan't I'm let's we've he'll don't",)], "t string")
    assert rows.select(X.preprocess("t").alias("x")).first().x == "There is a 'tick', ''two'', they are - you all will not, can not; shall not I am let us we have he will do not"


def test_word_counts_and_tfidf(spark):
    texts = ["b a a c", "", None, "a", "x " * 3000 + "a", "b b c c c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    counted = {(r.doc_id, r.word): r.k for r in features.word_counts(docs).collect()}
    assert counted == {(i, w): k for i, x in enumerate(texts) for w, k in collections.Counter((x or "").split()).items()}
    tf = {i: collections.Counter(" ".join(w[k : k + n]) for n in (1, 2) for k in range(len(w) - n + 1)) for i, w in ((i, (x or "").split()) for i, x in enumerate(texts))}
    df = collections.Counter(t for c in tf.values() for t in c)
    want = {}
    for i, c in tf.items():
        w = {t: k * (np.log((1 + len(texts)) / (1 + df[t])) + 1) for t, k in c.items() if 2 <= df[t] <= 0.9 * len(texts)}
        want |= {(i, t): x / np.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    got = {(r.doc_id, r.term): r.tfidf for r in features.tfidf(docs, (1, 2), 2, 0.9).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_pruned_paths(spark):
    rng = np.random.default_rng(1)
    sub = lambda a, b: any(list(c) == a for c in itertools.combinations(b, len(a)))
    for _ in range(100):
        paths = [rng.integers(0, 3, rng.integers(1, 5)).tolist() for _ in range(6)]
        kept = features.prune_subsequences(paths)
        assert all(any(sub(p, k) for k in kept) for p in paths) and not any(a is not b and sub(a, b) for a in kept for b in kept)
    assert spark.createDataFrame([([["a", "b"], ["a"], ["b", "a"]],)], "p array<array<string>>").select(features.pruned("p").alias("x")).first().x == [["a", "b"], ["b", "a"]]


def brute_betweenness(nodes, near):
    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        paths, level = [], [[s]]
        while level and not paths:
            paths = [p for p in level if p[-1] == t]
            level = [[*p, x] for p in level for x in near[p[-1]] if x not in p]
        for p in paths:
            for x in p[1:-1]:
                out[x] += 1 / len(paths)
    return {x: b / max((len(nodes) - 1) * (len(nodes) - 2), 1) for x, b in out.items()}


def test_betweenness(spark):
    rng = np.random.default_rng(2)
    for _ in range(3):
        edges = {tuple(sorted(map(int, e))) for e in rng.integers(0, 9, (11, 2)) if e[0] != e[1]}
        near = collections.defaultdict(set)
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        df = spark.createDataFrame([(a, b, 1) for a, b in edges], "e1 long, e2 long, weight int")
        got = {r.entity: r.betweenness for r in graph.betweenness(df).collect()}
        want = brute_betweenness(sorted(near), near)
        assert got.keys() == want.keys() and np.allclose([got[x] for x in want], list(want.values()))
    assert graph.betweenness(df.limit(0)).count() == 0


def test_tree_deeper_than_any_bound(spark):
    tree = spark.createDataFrame([("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 40)], "name string, parent string")
    assert {r.name: r.below for r in affect.subtree_sizes(tree).collect()} == {f"n{i}": 39 - i for i in range(40)}
    with pytest.raises(ValueError):
        affect.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "name string, parent string")).count()


def test_chunks_and_splits(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101, i % 3 == 0) for i in range(100)], "id int, x int, label boolean")
    sizes = collections.Counter(r.chunk for r in clustering.chunks(rows, ["x"], 7).collect())
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    order = lambda ids: sorted(ids, key=lambda i: (zlib.crc32(str(i).encode()), i))
    balanced = knowledge_graph.balanced(rows, "label", "id").collect()
    for label in (True, False):
        own = order([r.id for r in rows.collect() if r.label == label])
        assert {r.id for r in balanced if r.label == label} == set(own[:34])
        assert {r.id for r in knowledge_graph.stratified_split(rows, "label", "id", 0.25).collect() if r.test and r.label == label} == set(own[: int(len(own) * 0.25)])


def test_nearest_topic_in_blocks(spark, monkeypatch):
    from schism.operators import topics

    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(f"p{i}", rng.normal(size=4).tolist()) for i in range(30)], "np string, embedding array<double>")
    c = spark.createDataFrame([(f"t{i}", rng.normal(size=4).tolist()) for i in range(9)], "topic string, centroid array<double>")
    few = {r.np: (r.topic, round(r.distance, 9)) for r in topics.nearest_topic(v, c, 0.7).collect()}
    monkeypatch.setattr(clustering, "BROADCAST_CENTRES", 3)
    assert {r.np: (r.topic, round(r.distance, 9)) for r in topics.nearest_topic(v, c, 0.7).collect()} == few and few


def test_weighted_topics(spark):
    from schism.operators import topics

    rows = [("a", "t", v, k) for v, k in ((1, 3), (5, 1), (-2, 2))]
    counted = spark.createDataFrame(rows, "entity string, topic string, v int, k int")
    long = spark.createDataFrame([r[:3] for r in rows for _ in range(r[3])], "entity string, topic string, v int")
    assert topics.entity_topic_weights(counted, "v", 2, "k").collect() == topics.entity_topic_weights(long, "v", 2).collect()
    groups = spark.createDataFrame([(1, "a")], "fid int, entity string")
    assert topics.group_topic_weights(counted, groups, "v", 2.0, "k").collect() == topics.group_topic_weights(long, groups, "v", 2.0).collect()


def test_derived_counts(spark):
    parsed = syntax.parse(spark.createDataFrame([("u", 'I will say "we walked" and you talked')], "uid string, sentence string"))
    r = syntax.derived_counts(parsed, ["uid"]).first()
    assert (r.pos_future_tense, r.pos_past_tense, r.pos_i, r.pos_we, r.pos_you, r.pos_he_she, r.quotes, r.quoted) == (1, 2, 1, 1, 1, 0, 2, 1)


def test_long_parses(spark):
    short, long = "(S (NP (NN a)) (VP (VB b)))", "(S " + "(NN x) " * 71 + ")"
    rows = spark.createDataFrame([(1, [short, long]), (2, [long]), (3, []), (4, None)], "i int, parse array<string>")
    got = {r.i: (r.depth, r.np_count, r.vp_depth) for r in syntax.complexities(rows).collect()}
    assert got == {1: (3.0, 1.0, 2.0), 2: (None, None, None), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}


def test_arborescences(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i, rng.normal(size=3).tolist()) for s in range(3) for i in range(6)]
    got = collections.defaultdict(list)
    for r in syntax.group_arborescences(spark.createDataFrame(rows, "s int, i int, v array<double>"), "s", "i", "v").collect():
        got[r.s].append((r.parent, r.child))
    for s in range(3):
        m = np.array([v for k, _, v in rows if k == s])
        m = m / np.sqrt((m * m).sum(1))[:, None]
        inside, edges = {0}, set()
        while len(inside) < 6:
            edges.add(max(((a, b) for a in inside for b in set(range(6)) - inside), key=lambda e: m[e[0]] @ m[e[1]]))
            inside = {x for e in edges for x in e} | {0}
        assert set(got[s]) == edges
    with pytest.raises(ValueError):
        syntax.group_arborescences(spark.createDataFrame(rows, "s int, i int, v array<double>"), "s", "i", "v", 5)


def test_plugs(spark):
    rows = spark.createDataFrame([(1, "the cat is black"), (2, "nothing here"), (3, None)], "i int, sentence string")
    assert {r.i: [tuple(t) for t in r.triples] for r in annotators.open_triples(rows).collect()} == {1: [("the cat", "is", "black")], 2: [], 3: []}
    got = {r.i: r.embedding for r in annotators.encode(rows, lambda: annotators.hashed_words(8)).collect()}
    want = np.zeros(8)
    for w in "the cat is black".split():
        want[zlib.crc32(w.encode()) % 8] += 1
    assert np.allclose(got[1], want / np.sqrt((want * want).sum())) and got[3] == [0.0] * 8
    vectors = spark.createDataFrame([("b", [1.0, 2.0])], "word string, vector array<double>")
    m = metrics.embedding_matrix(spark.createDataFrame([("b",), ("a",), ("b",)], "word string"), vectors, 2)
    assert sorted((r.word, r.row, r.vector) for r in m.collect()) == [("a", 0, [0.0, 0.0]), ("b", 1, [1.0, 2.0])]


def test_yaml():
    lines = "# c\nA:\n  B:\n    - x\n    - \"y z\"\n  C: [p, q]\nD:\n- one\nE: single".split("\n")
    assert readers.read_yaml(lines) == {"A": {"B": ["x", "y z"], "C": ["p", "q"]}, "D": ["one"], "E": "single"}
    assert readers.read_yaml([]) == {}


def test_graph_accessors(spark):
    edges = [("a", "b", "Attitude", 1.0), ("b", "a", "Attitude", 1.0), ("a", "T:x", "Attitude", -1.0), ("a", "F1", "MemberOf", None), ("b", "F2", "MemberOf", None), ("F1", "D1_2", "PartOf", None), ("F2", "D1_2", "PartOf", None), ("F1", "F2", "Conflict", None), ("D1_2", "T:x", "Polarization", 0.4)]
    df = spark.createDataFrame([(*e[:3], None, "L", e[3]) for e in edges], "src string, dst string, type string, predicate string, label string, weight double")
    nodes = knowledge_graph.nodes(df)
    got = {name: {tuple(r) for r in knowledge_graph.accessor(df, nodes, name).collect()} for name in knowledge_graph.ACCESSORS}
    assert got == {"fellowship_members": {("F1", "a"), ("F2", "b")}, "fellowship_dipoles": {("F1", "D1_2"), ("F2", "D1_2")}, "dipole_fellowships": {("D1_2", "F1"), ("D1_2", "F2")}, "entity_fellowship": {("a", "F1"), ("b", "F2")}, "entity_topics": {("a", "T:x")}, "dipole_topics": {("D1_2", "T:x")}}
    own = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "uid int, id string")
    f = knowledge_graph.article_fellowships(own, df)
    assert {tuple(r) for r in f.collect()} == {(1, "F1"), (1, "F2"), (2, "F1")} and [tuple(r) for r in knowledge_graph.article_dipoles(f, df).collect()] == [(1, "D1_2")]
    assert spark.createDataFrame([(["x"], "x"), (None, "x")], "l array<string>, i string").select(X.contains("l", F.col("i")).alias("c")).collect() == [(True,), (False,)]
