"""Language model, classifiers and neighbour search against brute force and held-out rows."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from schism.llm import language, language_model, neighbours, quality
from schism.llm.elias_fano import EliasFano, Trie


def tokens(text):
    return (text or "").encode().lower().split() + [None]


class Counts:
    """Plain dictionaries of n-gram counts of the training rows."""

    def __init__(self, rows):
        self.c1, self.c2, self.c3, self.x1, self.x2 = (collections.Counter() for _ in range(5))
        for doc, text in rows:
            if zlib.crc32(str(doc if doc is not None else "").encode()) % 7 != 2:
                p = ["<", "<", *tokens(text)]
                for u, v, w in zip(p, p[1:], p[2:]):
                    for c, k in ((self.c1, w), (self.c2, (v, w)), (self.c3, (u, v, w)), (self.x1, v), (self.x2, (u, v))):
                        c[k] += 1
        self.n, self.v = sum(self.c1.values()), len(self.c1)

    def unigram(self, w):
        return (self.c1[w] + 1) / (self.n + self.v + 1)

    def score(self, text, m2=200.0, m3=4.0):
        p = ["<", "<", *tokens(text)]
        total = 0.0
        for u, v, w in zip(p, p[1:], p[2:]):
            low = (self.c2[v, w] + m2 * self.unigram(w)) / (self.x1[v] + m2)
            total += math.log10((self.c3[u, v, w] + m3 * low) / (self.x2[u, v] + m3))
        return total


@pytest.mark.parametrize("block", [1_500_000, 2_000])
def test_language_model(small, odd, none, monkeypatch, block):
    monkeypatch.setattr(language_model, "BLOCK_POSITIONS", block)
    for docs in (small, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        text, c = dict(rows), Counts(rows)
        out = language_model.score(docs).collect()
        assert len(out) == len(rows)
        for r in out:
            own = tokens(text[r.doc_id])
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2, len(own), sum(c.c1[w] > 0 for w in own), c.n)
            assert math.isclose(r.base_score, sum(math.log10(c.unigram(w)) for w in own), rel_tol=1e-9)
            assert math.isclose(r.score, c.score(text[r.doc_id]), rel_tol=0.01)
    assert language_model.score(none).count() == 0


def test_language_model_hot_context(spark):
    """A context word with a third of all positions is split by documents and still gives a model that beats single words."""
    rows = [(i, " ".join(f"the w{(i * 7 + k) % 50} a{k % 3}" for k in range(40))) for i in range(60)]
    out = language_model.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shard_positions=400).toPandas()
    assert len(out) == 60 and (out["score"] > out["base_score"]).mean() > 0.9 and (out["score"] < 0).all()


def test_language_model_hot_context_counts(spark):
    """Hot contexts, pairs and triples learn from all training rows, however many documents hold them."""
    rows = [(i, " ".join(f"one of the w{(i * 7 + k) % 50} the a{k % 3}" for k in range(30))) for i in range(60)]
    c = Counts(rows)
    out = language_model.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shard_positions=400).collect()
    assert len(out) == 60 and all(math.isclose(r.score, c.score(rows[r.doc_id][1]), rel_tol=1e-3) for r in out)


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((0, 4), (1, 1), (300, 200), (70_000, 1 << 40), (70_000, 100_000)):
        v = np.sort(r.integers(0, top, n)).astype(np.uint64)
        e = EliasFano.build(v, top)
        assert (e.decode(0, n) == v).all() and (e.decode(n // 3, n // 2) == v[n // 3 : n // 2]).all()
        if n:
            i = r.integers(0, n, 500)
            assert (e.access(i) == v[i]).all()
        t = np.sort(r.integers(0, top, 1000)).astype(np.uint64)
        where, same = e.successors(t)
        assert (where == np.searchsorted(v, t)).all() and (same == np.isin(t, v)).all()


def test_trie_file(tmp_path):
    r = np.random.default_rng(2)
    u, v, w = (np.minimum(r.zipf(1.4, 30_000), 400) for _ in range(3))
    Trie.build(u, v, w, 5.0, 2.0).save(f"{tmp_path}/t")
    c3, c2, x2, x1 = (collections.Counter(x) for x in (zip(u, v, w), zip(v, w), zip(u, v), v))
    q = [np.concatenate([x[:500], r.integers(0, 500, 500)]) for x in (u, v, w)]
    a, g = Trie.load(f"{tmp_path}/t").interpolation(*q)
    for x, y, z, found, gain in zip(*q, a, g):
        low, C = c2[y, z] / (x1[y] + 5), x2[x, y]
        assert math.isclose(found, c3[x, y, z] / (C + 2) + 2 / (C + 2) * low, rel_tol=0.003, abs_tol=1e-12) and math.isclose(gain, 2 / (C + 2) * 5 / (x1[y] + 5), rel_tol=0.003)


def test_neighbours_recall(spark):
    """The registered query's own factor over several shards of the registered table."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = vectors.collect()
    m, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = total = 0
    got = collections.defaultdict(set)
    for x in neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"), 10, shard_rows=500).collect():
        got[x.query_id].add(x.vec_id)
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        total += 10
    assert hits / total >= 0.9


def slow_features(text, buckets, chars):
    """Features of one text, one by one: {feature: value}."""
    from schism.llm.common import word_hashes

    raw = text.encode()
    low = raw.lower()
    words, at = low.split(), 0
    own = [w for w in raw.split()]
    hashed = collections.Counter()
    for w in words:
        a = np.frombuffer(w, np.uint8)
        hashed[int(word_hashes(a, np.array([0]), np.array([len(a)]))[0]) & (buckets - 1)] += 1
    value = {f: 1 + math.log(c) for f, c in hashed.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    out = {f: v / norm for f, v in value.items()}
    size, n = max(len(raw), 1), max(len(words), 1)
    count = lambda kinds: sum(c in kinds for c in raw)
    symbols = b"*$#%&@^~_=+<>{}[]\\/"
    upper = set(range(65, 91))
    stats = {
        "upper": count(upper) / max(sum(65 <= c <= 90 or 97 <= c <= 122 for c in raw), 1), "digit": count(b"0123456789") / size, "punctuation": count(b".,;:!?'\"()-") / size, "symbol": count(symbols) / size, "bar": count(b"|") / size,
        "other_bytes": sum(c >= 128 for c in raw) / size, "distinct_words": len(hashed) / n, "most_frequent_word": max(hashed.values(), default=0) / n, "repeated_next": sum(x == y for x, y in zip(words, words[1:])) / n,
        "long_words": sum(len(w) > 14 for w in words) / n, "short_words": sum(len(w) < 3 for w in words) / n, "upper_words": sum(sum(c in upper for c in w) > 1 for w in own) / n,
        "marked_words": sum(any(c in symbols + b"|!" for c in w) for w in own) / n, "words": len(words), "lines": raw.count(b"\n") + 1, "mean_word": sum(map(len, words)) / n, "chars": len(text) if chars is None else chars,
    }
    for k, (name, edges) in enumerate(quality.STATS.items()):
        out[buckets + 16 * k + sum(stats[name] >= e for e in edges)] = 0.5
    return out


def test_quality_features_and_scores(odd, small):
    """Features one by one, and scores as the sum over all pairs of features."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    buckets = 1 << 10
    size = buckets + 16 * len(quality.STATS)
    model = quality.Machine(0.1, r.normal(size=size) * 0.3, r.normal(size=(size, 3)) * 0.2, buckets)
    rows = [(x.doc_id, x.text, x.n_chars) for docs in (odd.filter("doc_id < 10 or doc_id is null"), small.limit(25)) for x in docs.collect()]
    got = model.score(*quality.features(pa.array([t or "" for _, t, _ in rows], pa.large_string()), buckets, pa.array([n for _, _, n in rows], pa.int64())), len(rows))
    for (_, text, chars), score in zip(rows, got):
        own = slow_features(text or "", buckets, chars)
        f, x = list(own), list(own.values())
        margin = model.bias + sum(model.weights[i] * v for i, v in zip(f, x)) + sum(model.factors[f[i]] @ model.factors[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i)) if len(f) < 300 else None
        assert margin is None or math.isclose(score, 1 / (1 + math.exp(-min(max(margin, -30), 30))), rel_tol=1e-6)


def test_quality_labels(spark):
    """Labels that contradict each other don't teach; an id with several documents teaches one of them."""
    docs = spark.createDataFrame([(i, f"good text {i}" if i % 2 else f"bad words {i}") for i in range(40)] + [(1, "another good text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (3, 1), (5, None), (None, 1)], "doc_id long, quality int")
    lists, y = quality.training_rows(docs, labels, 1 << 10, 1000)
    taught = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 and i != 3]
    assert len(lists) == len(y) == len(taught) and y.tolist() == [i % 2 for i in taught]
    assert len(quality.training_rows(docs, labels, 1 << 10, 7)[0]) == 7


def slow_subwords(text, buckets):
    """Buckets of all words and their n-grams, one by one."""
    from schism.llm.common import mix, word_hashes

    out = []
    for w in text.encode().lower().split():
        framed = np.frombuffer(b"\2" + w + b"\1", np.uint8)
        hashes = [int(word_hashes(framed, np.array([0]), np.array([len(framed)]))[0])]
        for n in (2, 3, 4):
            for k in range(len(framed) - n + 1):
                hashes.append(int(mix(np.array([int.from_bytes(framed[k : k + n].tobytes(), "little") + (n << 56)], np.uint64))[0]))
        out += [(h >> 20) & (buckets - 1) for h in hashes]
    return out


def test_language_scores(odd, small):
    """Scores as the softmax of the mean of the subwords' class scores."""
    import pyarrow as pa

    r = np.random.default_rng(6)
    buckets = 1 << 9
    model = language.Model(["a", "b", "c"], r.normal(size=(buckets, 3)), r.normal(size=3), 0.7, 0.4)
    texts = [x.text or "" for docs in (odd.filter("doc_id < 10"), small.limit(25)) for x in docs.collect()]
    p = model.probabilities(*language._class_sums(pa.array(texts, pa.large_string()), model.scores))
    for text, found in zip(texts, p):
        own = slow_subwords(text, buckets)
        z = (model.scores[own].mean(0) if own else 0) + model.bias
        want = np.exp(z / 0.7) / np.exp(z / 0.7).sum()
        assert np.allclose(found, want)


def test_language_sample(spark):
    """At most so many rows of a language, whatever ids repeat; more languages than any fixed list."""
    rows = [(i % 3, f"wort{i} und", "de") for i in range(500)] + [(i, f"word {i}", f"l{i % 40}") for i in range(200)]
    languages, lists, target = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 1 << 9, 30)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert set(languages) == {"de"} | {f"l{i % 40}" for i in held} and (target == languages.index("de")).sum() <= 30 and len(lists) - (target == languages.index("de")).sum() == len(held)


def test_quality(spark, odd, none, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(docs, labels)
    held = quality.score(docs, model).join(labels, "doc_id").toPandas()
    held = held[[zlib.crc32(str(i).encode()) % 5 == 0 for i in held["doc_id"]]]
    assert ((held["score"] >= 0.3) == (held["quality"] == 1)).mean() > 0.9
    scores = quality.score(odd, model).toPandas()["score"]
    assert len(scores) == odd.count() and scores.between(0, 1).all()
    blank = quality.fit(odd, labels.limit(0))
    assert set(quality.score(odd, blank).toPandas()["score"]) == {0.5}
    assert quality.score(none, model).count() == 0
    everything = quality.keep(odd, model, 0.0)
    assert everything.dtypes == odd.dtypes and sorted(everything.collect(), key=str) == sorted(odd.collect(), key=str)


def test_factorisation_machine_margin():
    """The linear-time sum of squares equals the sum over pairs."""
    r = np.random.default_rng(0)
    model = quality.Machine(0.3, r.normal(size=20), r.normal(size=(20, 4)), 16)
    f, x = r.permutation(20)[:7], r.normal(size=7)
    pairs = sum(model.factors[f[i]] @ model.factors[f[j]] * x[i] * x[j] for i in range(7) for j in range(i))
    assert np.isclose(model.margin(np.zeros(7, int), f, x, 1)[0][0], 0.3 + model.weights[f] @ x + pairs)


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    out = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and out["rejected"].mean() < 0.02
    got = {r.doc_id: r for r in language.predict(odd, model).collect()}
    for doc in (3, 4, 5, 8):
        assert (got[doc].lang_pred, got[doc].score, got[doc].rejected) == ("und", 0.0, True)
    assert got[6].lang_pred in model.languages and 0 < got[6].score <= 1
    blank = language.fit(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang <> ''"))
    assert {r.lang_pred for r in language.predict(odd, blank).collect()} == {"und"}
    assert language.predict(none, model).count() == 0
    kept = language.keep(odd, model)
    assert kept.dtypes == odd.dtypes and not {3, 4, 5, 8} & {r.doc_id for r in kept.collect()}


def brute(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q in queries:
            near = sorted((math.sqrt(((x - y) ** 2).sum()), i) for i, y in ok if i != q)[:k]
            out[q] = [(i, d) for d, i in near]
    return out


def test_neighbours(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(40)]  # many ties
    rows += [(800, None), (801, [0.0] * 6), (802, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (900, [float("nan")] * 6), (None, rows[1][1]), (803, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = df.filter("vec_id % 100 = 0")
    want = brute(rows, {i for i, _ in rows if i is not None and i % 100 == 0}, 10)
    for options in ({"factor": 1.0, "shard_rows": 200}, {"factor": 1.0, "shard_rows": 10_000, "query_rows": 3}):
        got = collections.defaultdict(list)
        for x in neighbours.search(df, queries, 10, **options).orderBy("query_id", "rank").collect():
            got[x.query_id].append((x.vec_id, x.score))
        assert dict(got) == want
    relaxed = collections.defaultdict(set)
    for x in neighbours.search(df, queries, 10).collect():
        relaxed[x.query_id].add(x.vec_id)
    assert np.mean([len(relaxed[q] & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    wide = df.union(spark.createDataFrame([(1000 + i, [1.0, 2.0]) for i in range(5)], df.schema)).withColumns({"score": F.lit(1), "rank": F.lit(2), "shard": F.lit("x"), "query_id": F.lit(None)})
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 200)  # queries in several groups
    got = collections.defaultdict(list)
    for x in neighbours.search(wide, wide.filter("vec_id % 100 = 0"), 10, factor=1.0, shard_rows=100).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    assert dict(got) == want  # of lengths the most common counts
    assert neighbours.search(df.limit(0), queries).count() == 0 and neighbours.search(df.limit(3), df.limit(3)).filter("rank > 2").count() == 0
