"""Ideology, affect, syntax and learning on small cases."""

import numpy as np
from pyspark.sql import functions as F

from schism.operators import affect, ideology, learning, syntax


def test_ideology(spark):
    box = spark.createDataFrame([("a", {"party": "[[R Party|R]]"}), ("b", {"party": "[[D Party]] [[R Party]]"}), ("c", {}), ("R Party", {"ideology": "[[X]], [[Y|y]]"})], "entity string, fields map<string,string>")
    assert ideology.nonempty(box).count() == 3
    p = ideology.parties(box)
    assert {(r.entity, r.party) for r in p.collect()} == {("a", "R Party"), ("a", "R"), ("b", "D Party"), ("b", "R Party")}
    assert [(r.entity, r.label) for r in ideology.affiliations(p, {"R": ("R Party",), "D": ("D Party",)}).collect()] == [("a", "R")]
    i = ideology.ideology_text(box)
    assert [(r.party, r.ideology) for r in i.collect()] == [("R Party", "X Y y")]
    assert {r.entity for r in ideology.entity_ideology(p, i).collect()} == {"a", "b"}


def test_affect(spark):
    tree = spark.createDataFrame([("root", None), ("joy", "root"), ("glee", "joy"), ("fear", "root")], "name string, parent string")
    assert {r.name: r.emotion for r in affect.at_level(tree, 1).collect()} == {"root": "root", "joy": "joy", "glee": "joy", "fear": "fear"}
    assert {r.name: r.below for r in affect.subtree_sizes(tree).collect()} == {"root": 3, "joy": 1, "glee": 0, "fear": 0}
    words = spark.createDataFrame([("x", "n"), ("y", "n")], "word string, pos string")
    senses = spark.createDataFrame([("x", "n", 1, 10), ("x", "n", 2, 11), ("x", "n", 3, 12)], "word string, pos string, rank int, synset int")
    assert [(r.word, r.emotion) for r in affect.word_emotions(words, senses, spark.createDataFrame([(11, "joy"), (12, "fear")], "synset int, emotion string")).collect()] == [("x", "joy")]


def test_syntax(spark):
    parsed = syntax.parse(spark.createDataFrame([("u", "The dog quickly barked, 2 times")], "uid string, sentence string"))
    tags = {r.tag: r.n for r in syntax.pos_counts(parsed, ["uid"]).collect()}
    assert tags == {"DT": 1, "NN": 1, "RB": 1, "VBD": 1, ".": 1, "CD": 1, "NNS": 1}
    rows = parsed.withColumns({"source": F.array(F.lit(1)), "target": F.array(F.lit(6))})
    assert syntax.attitude_paths(rows).first().paths == [["quickly", "barked", ",", "2"]]
    t = syntax.read_tree("(S (NP (DT the) (NN dog)) (VP (VB sees) (NP (NN me))))")
    assert syntax.tree_depth(t) == 4 and syntax.leaves(t) == ["the", "dog", "sees", "me"] and syntax.leaves_beside(t, (1, 0)) == (2, 1)
    assert syntax.complexity(t) == {"depth": 4.0, "np_count": 2.0, "np_depth": 2.0, "vp_count": 1.0, "vp_depth": 3.0}
    assert syntax.tree_hash(t) == syntax.tree_hash(syntax.read_tree("(S (NP (DT the)  (NN dog)) (VP (VB sees) (NP (NN me))))"))
    edges = syntax.arborescence(np.array([[0, 5, 1], [0, 0, 4], [0, 0, 0]]), 0)
    assert edges == [(0, 1), (1, 2)] and syntax.arborescence_stats(edges, 0) == {"height": 2.0, "leaves": 1.0, "mean_distance": 1.0}


def test_learning(spark):
    triples = spark.createDataFrame([(f"a{i}", "likes", f"b{i % 3}") for i in range(30)], "subject string, predicate string, object string")
    entities, relations = learning.embed_triples(triples, 8, 30)
    e, w = {r.name: np.array(r.vector) for r in entities.collect()}, np.array(relations.first().vector)
    right = np.mean([(e[f"a{i}"] * w) @ e[f"b{i % 3}"] > (e[f"a{i}"] * w) @ e[f"b{(i + 1) % 3}"] for i in range(30)])
    assert len(e) == 33 and right > 0.8
    samples = spark.createDataFrame([(f"p{i}", i % 2, f"a{(i % 2) * 15 + k}", f"b{i % 2}") for i in range(24) for k in range(3)], "path string, label int, s string, o string")
    model, ready = learning.classifier(learning.pooled_features(samples, entities), folds=2)
    scored = model.transform(ready).select("label", "prediction").toPandas()
    assert (scored["label"] == scored["prediction"]).mean() > 0.9
    masked = spark.createDataFrame([("good",), ("bad",)], "masked string")
    out = {r.masked: r.proba for r in learning.infer_attitudes(masked, lambda: lambda texts: [[0, 0, 5] if t == "good" else [5, 0, 0] for t in texts]).collect()}
    assert out["good"].positive > 0.9 and out["bad"].negative > 0.9


def test_averages_of_a_long_series(spark, monkeypatch):
    """A series that lies in several ranges and blocks has the averages of a loop over it."""
    from schism.operators import moving

    monkeypatch.setattr(moving, "BLOCK", 7)
    random = np.random.default_rng(3)
    names = ["a"] * 200 + ["b", "b", None, None, None] + ["c"] * 40
    rows = [(k, i, float(x)) for i, (k, x) in enumerate(zip(names, random.normal(0, 5, len(names))))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, i int, x double").repartition(5)
        assert moving._ranges(df, ["k"], ["i"]).filter("k = 'a'").select("__range").distinct().count() > 2
        args = (df, ["k"], ["i"], "x")
        found = {f: {r.i: r[c] for r in d.collect()} for f, d, c in (("s", moving.simple(*args, 5), "sma"), ("c", moving.cumulative(*args), "cma"), ("w", moving.weighted(*args, 4), "wma"), ("e", moving.exponential(*args, 0.2), "ema"), ("n", moving.simple(*args, 5, -1, partial=False), "sma"))}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for name in ("a", "b", None, "c"):
        own, ema = [r for r in rows if r[0] == name], None
        for j, (_, i, x) in enumerate(own):
            xs = [r[2] for r in own[: j + 1]]
            ema = x if ema is None else 0.2 * x + 0.8 * ema
            tail = xs[-4:]
            want = {"s": np.mean(xs[-5:]), "c": np.mean(xs), "w": sum(v * (q + 1) for q, v in enumerate(tail)) / sum(range(1, len(tail) + 1)), "e": ema, "n": np.mean(xs[-5:]) if j >= 4 else -1}
            assert all(abs(found[f][i] - want[f]) < 1e-9 for f in want), (name, j)
    empty = spark.createDataFrame([], "k string, i int, x double")
    assert [f(empty, ["k"], ["i"], "x", *more).count() for f, more in ((moving.simple, (3,)), (moving.cumulative, ()), (moving.weighted, (3,)), (moving.exponential, (0.5,)))] == [0] * 4


def test_scorers_and_trees(spark):
    """Plugged-in scorers of graphs (G11), trees from plugged-in scores (L7), and a classifier of texts."""
    from schism.operators import graph

    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", -1), ("a", "c", -1), ("c", "d", 1)], "e1 string, e2 string, weight int")
    given = []
    degree = lambda n, rows: given.append(rows) or [sum(x in r[:2] for r in rows) for x in range(n)]
    assert {r.entity: r.pole for r in graph.node_scores(edges, degree).collect()} == {"a": 2, "b": 2, "c": 3, "d": 1}
    assert {r.entity: r.pole for r in graph.node_scores(edges).collect()} == dict.fromkeys("abcd")
    total = lambda n, rows: n + sum(w for _, _, w in rows)
    assert [graph.graph_score(edges, total, without).collect() for without in (None, "c", "zz")] == [[(4.0,)], [(3.0,)], [(4.0,)]]
    assert graph.graph_score(edges.filter("e1 = 'c'"), total, "c").collect() == [] == graph.node_scores(edges.limit(0), degree).collect()
    rows = spark.createDataFrame([(1, ["x", "y", "z"]), (2, []), (3, None)], "i int, tokens array<string>")
    assert {r.i: r.heads for r in syntax.scored_trees(rows).collect()} == {1: [-1, 0, 1], 2: [], 3: []}
    star = lambda: lambda tokens: np.eye(len(tokens))[[1] * len(tokens)].T
    assert {r.i: r.heads for r in syntax.scored_trees(rows, star, root=1).collect()}[1] == [1, -1, 1]
    texts = spark.createDataFrame([(i, f"good fine {i}" if i % 2 else f"bad poor {i}", float(i % 2)) for i in range(60)] + [(99, "good", None)], "i int, text string, label double")
    model, ready = learning.text_classifier(texts, folds=2)
    found = model.transform(ready).select("label", "prediction").collect()
    assert len(found) == 60 and all(r.label == r.prediction for r in found)


def test_consensus_distances():
    """Jaccard distances and Ward's merges equal a loop over pairs, whatever the size of a portion."""
    from schism.operators import communities

    random = np.random.default_rng(2)
    sets = [set(map(int, random.integers(0, 12, int(k)))) for k in random.integers(1, 9, 30)]
    want = [[0 if i == j else 1 - len(a & b) / len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for most in (1, 7, 1 << 22):
        assert np.allclose(communities._jaccard_distance(sets, most), want)
    d, members = np.array(want) ** 2, [[k] for k in range(len(sets))]
    size = np.ones(len(sets))
    while True:  # every pair looked at before every merge
        pairs = [(d[i, j], i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if members[i] and members[j]]
        low, i, j = min(pairs)
        if low**0.5 > 0.6:
            break
        for k in range(len(sets)):
            if members[k] and k not in (i, j):
                d[i, k] = d[k, i] = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * low) / (size[i] + size[j] + size[k])
        size[i] += size[j]
        members[i], members[j] = members[i] + members[j], []
    label = communities.ward(np.array(want), 0.6)
    assert {tuple(sorted(m)) for m in members if m} == {tuple(np.flatnonzero(label == c)) for c in range(label.max() + 1)}
