"""Exact dedup and the n-gram Jaccard join against brute force."""

import collections
import random

import pytest

from schism.llm import exact_dedup, jaccard_join
from schism.llm.components import components


def brute_components(rows, n, num, den):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and sets[a]:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("n,threshold", [(4, (85, 100)), (5, (80, 100))])
def test_join_small_table(spark, small, n, threshold):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    assert got(jaccard_join.join_components(small, n, threshold)) == brute_components(rows, n, *threshold)


def test_join_shards_follow_input(spark, small, monkeypatch):
    """More input gives more shards, up to a bound; the links stay the same."""
    want = got(jaccard_join.join_components(small))
    few = jaccard_join._Join(small, 5, (80, 100)).bits
    monkeypatch.setattr(jaccard_join, "SHARD_BYTES", 64)
    many = jaccard_join._Join(small, 5, (80, 100)).bits
    assert few < many <= jaccard_join.MOST_BITS
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 8)
    assert jaccard_join._Join(small, 5, (80, 100)).bits == 8 and got(jaccard_join.join_components(small)) == want


@pytest.mark.parametrize("frequent,paired,tile", [(2, 256, 512), (3, 2, 3), (1000, 3, 4)])
def test_join_groups_of_copies(spark, monkeypatch, frequent, paired, tile):
    """Large groups of near copies, some linked through one text only, whatever the classes and tiles are."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    random.seed(frequent)
    rows = []
    for base in range(4):
        words = [f"b{base}w{i}" for i in range(60)]
        shared = [f"common{i}" for i in range(40)]
        for copy in range(12):
            w = list(words)
            for _ in range(copy % 4):
                w[random.randrange(60)] = f"edit{base}-{copy}-{random.random()}"
            rows.append((len(rows), " ".join(w + (shared if copy % 3 == 0 else []))))
    rows += [(len(rows) + i, rows[i][1]) for i in range(5)] + [(90, "one two"), (91, "One Two"), (92, ""), (93, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, threshold in ((4, (85, 100)), (3, (60, 100))):
        assert got(jaccard_join.join_components(docs, n, threshold)) == brute_components(rows, n, *threshold)


def test_join_odd_rows(odd, none):
    out = jaccard_join.join_components(odd, 4, (85, 100)).collect()
    assert len(out) == odd.count()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert found[1] == found[2] == (3, 1) and found[None] == (3, 1)
    assert found[3] == (0, 3) and found[4] == (0, 4) and found[5] == (0, 5) and found[7] == (1, 7) and found[10] == (29_997, 10)
    assert jaccard_join.join_components(none).count() == 0
    kept = jaccard_join.keep_one(odd, n=4, threshold=(85, 100))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert jaccard_join.keep_one(none).count() == 0


def test_join_blank_tables(spark):
    """Partitions and tables without any word."""
    for rows in ([(1, None)], [(1, None), (2, "")], [(1, ""), (2, " "), (3, " \n")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(jaccard_join.join_components(docs)) == {i: (0, i) for i, _ in rows}
        assert jaccard_join.keep_one(docs).count() == len(rows)


ROWS = [(7, "one text and some more"), (9, "one text and some more"), (7, "other words that are not alike"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "x y z u v w"), (None, "x y z u v w"), (4, "X y z u v w"), (None, "lone words only in here"), (None, "lone words only in here"), (6, "Abc abc"), (6, "abc abc")]


def test_kept_row_by_row(spark):
    """Of rows that repeat id and text one stays, whatever the id; an id on two texts loses only the copy."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    alone = [(7, "other words that are not alike"), (5, "a b c d e f"), (4, "X y z u v w"), (None, "lone words only in here")]
    low = lambda df: sorted(((r.doc_id, r.text.lower() if r.doc_id == 6 else r.text) for r in df.collect()), key=str)
    assert low(exact_dedup.keep_unique(docs)) == sorted([*alone, (9, "one text and some more"), (6, "abc abc")], key=str)
    assert low(jaccard_join.keep_one(docs)) == sorted([*alone, (7, "one text and some more"), (6, "abc abc")], key=str)


def test_exact_dedup_state(spark, small, tmp_path):
    """A later run is deduplicated against what earlier runs left in the state, and repeats of a run change nothing."""
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    parts = rows[:120], rows[120:] + [(1000 + i, t) for i, t in rows[:50]] + [(2000, "Brand new"), (2001, "brand NEW")], [(3, rows[0][1]), (5000, "brand new")]
    seen = []
    for k, part in enumerate(parts):
        docs = spark.createDataFrame(part, "doc_id long, text string").repartition(2)
        seen += part
        want = {(d, keep, n) for d, keep, n, _ in brute_dedup(seen)}
        for _ in range(2 if k == 1 else 1):
            out = exact_dedup.dedup(docs, state=f"file://{tmp_path}/state", run=f"r{k}").collect()
            assert len(out) == len(part) and all((r.doc_id, r.keep_id, r.group_size) in want for r in out)
    docs = spark.createDataFrame([(6000, "BRAND new"), (1, "brand new"), (2, "never seen")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.keep_unique(docs, state=f"file://{tmp_path}/state", run="last").collect()) == [2, 6000]
    with pytest.raises(ValueError):
        exact_dedup.dedup(docs, 4, state=f"file://{tmp_path}/state", run="short")


def test_components(spark):
    random.seed(3)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    up = {x: x for e in links for x in e if e[0] != e[1]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert {r.node: r.root for r in components(df).collect()} == {x: root(x) for x in up}
    assert components(df.limit(0)).count() == 0


def test_across_tiles(spark, monkeypatch):
    """Texts that link only through one that isn't the family's head."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard_join, "TILE", 2)
    import numpy as np

    base = np.arange(100, dtype=np.uint64)
    sets = [base, np.concatenate([base[8:], base[:8] + np.uint64(1000)]), np.concatenate([base[:-8], base[:8] + np.uint64(2000)]), base + np.uint64(5000), np.concatenate([base[:-4] + np.uint64(5000), base[:4] + np.uint64(9000)])]
    rows = [(i, 7, i, len(s), bytearray(np.sort(s).tobytes())) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, family long, root long, n long, values binary")
    join = jaccard_join._Join(spark.createDataFrame([], "doc_id long, text string"), 4, (80, 100))
    links = join.across(df.select("node", "family", F.when(F.col("node") == 1, 0).otherwise(F.col("node")).cast("long").alias("root")), df.select("node", "n", "values"))
    assert {tuple(sorted((r.a, r.b))) for r in links.collect()} == {(0, 2), (3, 4)}


def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[(text or "").encode().lower()].append(doc)
    best = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in groups.items()}
    return sorted(((d, best[k], len(v), d == best[k]) for k, v in groups.items() for d in v), key=str)


@pytest.mark.parametrize("width,files", [(32, None), (1, None), (32, 1)])
def test_exact_dedup(odd, small, width, files):
    for docs in (odd, small.select("doc_id", "text").union(small.select(small.doc_id + 100_000, small.text).limit(60)).repartition(4)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = exact_dedup.dedup(docs, width, files).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out), key=str) == brute_dedup(rows)


def test_exact_dedup_empty_and_filter(odd, none):
    assert exact_dedup.dedup(none).count() == 0
    kept = exact_dedup.keep_unique(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6, 7, 8, 9, 10] and exact_dedup.keep_unique(none).count() == 0
