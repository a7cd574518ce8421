"""Tokenizer operators against the library, packing against its invariants."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from schism.llm import bpe, packing, token_counts, token_files
from schism.llm.common import text_bytes

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORD_BPE)
OWN = bpe.Bpe(WORD_BPE)
TABLE = token_files.IdTable(token_files.Encoder(WORD_BPE), 200)
TEXT = st.text(st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from(list("abcdeéßÀ '’.,!0123 \n\tΣσİ"))), max_size=60)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_bpe_round(text):
    assert OWN.encode(text) == ids_of(text)
    assert OWN.decode(OWN.encode(text)) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)
    both = pa.array([text, "", text], pa.large_string())
    found, borders = TABLE.encode(*text_bytes(both), 2)
    assert found.tolist() == [*ids_of(text), 2, 2, *ids_of(text), 2] and borders.tolist() == [0, len(ids_of(text)) + 1, len(ids_of(text)) + 2, len(found)]


@pytest.mark.parametrize("form", ["a%s1", "%s\u0301%s\u0334\u0315"])
def test_every_code_point(form):
    """Characters that Python's Unicode tables don't know, or know otherwise than the library's, are no exception."""
    own = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x32000), *range(0x32000, 0x110000, 997)]]
    texts = [form.replace("%s", c) for c in own]
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [OWN.encode(t) for t in texts] == want
    found, borders = TABLE.encode(*text_bytes(pa.array(texts, pa.large_string())), 2)
    assert found.tolist() == [i for ids in want for i in [*ids, 2]]


def thue_morse(length):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(length))


def test_words_that_polynomials_confuse():
    from schism.llm.common import text_bytes, spans, word_hashes

    for size in (16, 64, 65, 1024, 4096):
        word = thue_morse(size)
        twin = word.translate({97: "b", 98: "a"})
        texts = pa.array([word, twin, f"{word} {twin} {word}x"], pa.large_string())
        raw, offsets = text_bytes(texts)
        assert len(set(word_hashes(raw, *spans(raw, offsets)[:2]).tolist())) == 3
        found, _ = token_files.IdTable(token_files.Encoder(WORD_BPE)).encode(raw, offsets, 2)
        assert found.tolist() == [i for t in texts.to_pylist() for i in [*ids_of(t), 2]]


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_id_table_compares_bytes(monkeypatch, bits):
    """Hashes of a few bits change nothing."""
    real = token_files.word_hashes
    monkeypatch.setattr(token_files, "word_hashes", lambda *a: real(*a) & np.uint64((1 << bits) - 1))
    table = token_files.IdTable(token_files.Encoder(WORD_BPE))
    for texts in (["one"], ["two"], ["one two three", "", "two " * 5 + thue_morse(200)], ["one one"]):
        found, _ = table.encode(*text_bytes(pa.array(texts, pa.large_string())), 2)
        assert found.tolist() == [i for t in texts for i in [*ids_of(t), 2]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \0", max_size=80), max_size=12))
def test_word_hashes(texts):
    """Equal words have equal hashes, wherever they stand; different ones differ."""
    from schism.llm.common import same_bytes, spans, word_hashes

    raw, offsets = text_bytes(pa.array(texts, pa.large_string()))
    starts, ends, first = spans(raw, offsets)
    words = [w for t in texts for w in t.encode().split()]
    assert first[-1] == len(words)
    hashes = word_hashes(raw, starts, ends).tolist()
    assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    if words:
        other = np.full(len(words), starts[0])
        alike = same_bytes(raw, starts, raw, other, np.minimum(ends - starts, ends[0] - starts[0]))
        assert alike.tolist() == [w[: len(words[0])] == words[0][: len(w)] for w in words]


def test_bpe_digests(odd, none, small):
    for docs in (odd, small):
        text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = bpe.digests(docs, WORD_BPE).collect()
        assert len(out) == docs.count()
        for r in out:
            ids = ids_of(text[r.doc_id])
            decoded = LIBRARY.decode(ids, skip_special_tokens=False)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.digests(none, WORD_BPE).count() == 0
    assert [r.ids for r in bpe.encode(odd.filter("doc_id = 9"), WORD_BPE).collect()] == [ids_of("it's <|endoftext|> I'LL  don't")]


def test_token_files(spark, odd, none, small, tmp_path):
    for i, docs in enumerate((odd, small)):
        rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        path = f"{tmp_path}/{i}"
        token_files.write(docs, path, WORD_BPE)
        files = token_files.read(spark, path)
        out = sorted(token_files.summary(files).collect(), key=lambda r: r.start)
        start = 0
        for (doc, text), r in zip(rows, out, strict=True):
            ids = [*ids_of(text), 2]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        assert files.filter("doc_id = 7").select("tokens").first().tokens == [*ids_of(dict(rows)[7]), 2]
    assert token_files.encode_and_check(none, WORD_BPE).count() == 0


def slow_pieces(word, initial, inner):
    n = at = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in (inner if at else initial):
                at, n = end, n + 1
                break
        else:
            return -1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4)), st.sets(st.text("abc", min_size=1, max_size=4)), st.lists(st.text("abcd", min_size=1, max_size=12), max_size=20))
def test_longest_match(initial, inner, words):
    automaton = token_counts.LongestMatch(initial, inner)
    for w in words:
        assert automaton.count(w) == slow_pieces(w, initial, inner)


def test_token_counts(odd, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    initial, inner = map(set, token_counts.pieces(model))
    text = {r.doc_id: r.text for r in odd.select("doc_id", "text").collect()}
    for r in token_counts.counts(odd, model).collect():
        found = [slow_pieces(w.decode(), initial, inner) for w in (text[r.doc_id] or "").encode().split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(found), sum(max(f, 1) for f in found), found.count(-1))
    assert token_counts.counts(none, model).count() == 0


def slow_whole(word, own):
    word, n, known = "▁" + word, 0, True
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in own), 0)
        n += 1 if size else len(word[0].encode())
        known &= size > 0
        word = word[size or 1 :]
    return n, known


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé▁", min_size=1, max_size=4)), st.lists(st.text("abcé日▁", min_size=1, max_size=12), max_size=20))
def test_whole_match(own, words):
    automaton = token_counts.WholeMatch(own)
    for w in words:
        assert abs(automaton.count(w)) == slow_whole(w, own)[0]


def test_whole_token_counts(spark, odd):
    """No word collapses to one token: the lone mark and byte pieces are used, in the registered query too."""
    from schism.llm import queries

    model = public_tokenizers.path("piece_bpe_32k.model")
    own = set(token_counts.whole_pieces(model)[0])
    assert "▁" in own and token_counts.whole_pieces(model)[1]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(20, "ñandú \U00010330"), (21, "日" * 3500)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in token_counts.counts(docs, model, cover=True).collect()}
    for doc, r in got.items():
        found = [slow_whole(w.decode(), own) for w in (text[doc] or "").encode().split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(found), sum(n for n, _ in found), sum(not known for _, known in found))
    assert (got[20].n_tokens, got[20].n_unknown, got[21].n_tokens, got[21].n_unknown) == (9, 1, 3501, 0)
    sf = "/root/testdata/sf0.001"
    want = sum(slow_whole(w.decode(), own)[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for w in (r.text or "").encode().split())
    assert sum(r.n_tokens for r in queries.op6_token_counts(spark, sf).collect()) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_pack(sizes):
    place, start, capacity = packing.pack(sizes, (16, 32, 64))
    used = {}
    for i, (b, s) in enumerate(zip(place, start)):
        used[b] = used.get(b, 0) + sizes[i]
    for b, u in used.items():
        assert capacity[b] == min(c for c in (16, 32, 64) if c >= u)
    taken = sorted((b, s, s + n) for b, s, n in zip(place, start, sizes))
    assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(taken, taken[1:]))
    alone = [min(c for c in (16, 32, 64) if c >= n) for n in sizes]
    assert sum(map(packing.cost, capacity)) <= sum(map(packing.cost, alone))


def slow_pack(sizes, capacities):
    """Best fit by looking at every bin each time; the bin to open is the one of least cost less what its rest is worth."""
    cheapest = min(packing.cost(c) / c for c in capacities)
    bins, place, left, filled = [], [None] * len(sizes), 1.0, 1.0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(b["room"], -b["late"], k) for k, b in enumerate(bins) if b["room"] >= sizes[i]]
        if fit:
            k = min(fit)[2]
            filled += sizes[i]
        else:
            worth = cheapest * min(1.0, filled / left)
            size = min((c for c in capacities if c >= sizes[i]), key=lambda c: (packing.cost(c) - worth * (c - sizes[i]), c))
            left += size - sizes[i]
            k = len(bins)
            bins.append({"room": size, "used": 0, "late": 0})
        place[i] = (k, bins[k]["used"])
        bins[k]["room"] -= sizes[i]
        bins[k]["used"] += sizes[i]
        bins[k]["late"] = 1 + max(b["late"] for b in bins)
    return [p[0] for p in place], [p[1] for p in place], [min(c for c in capacities if c >= b["used"]) for b in bins]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_pack_against_slow(sizes):
    assert packing.pack(sizes, (16, 32, 64)) == slow_pack(sizes, (16, 32, 64))


def test_pack_tokens(odd, small):
    """Lengths of a tokenizer, very long texts in pieces, null and repeated ids dealt like others."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    own = set(token_counts.whole_pieces(model)[0])
    for docs in (odd, small):
        want = sorted((-1 if r.doc_id is None else r.doc_id, 1 + sum(slow_whole(w.decode(), own)[0] for w in (r.text or "").encode().split())) for r in docs.select("doc_id", "text").collect())
        out = packing.pack_documents(docs, tokenizer=model).toPandas()
        out["doc_id"] = out["doc_id"].fillna(-1)
        first = out[out["piece"] == 0]
        assert len(first) == len(want) and out["n_tokens"].sum() == sum(n for _, n in want) and (out["n_tokens"] <= 4096).all()
        unique = {d: n for d, n in want if sum(x == d for x, _ in want) == 1}
        got = out.groupby("doc_id")["n_tokens"].sum().to_dict()
        assert all(got[d] == n for d, n in unique.items())


def test_pack_documents(odd, none, small):
    for docs in (odd, small):
        lengths = sorted((r.doc_id or -1, len((r.text or "").encode().split()) + 1) for r in docs.select("doc_id", "text").collect())
        out = packing.pack_documents(docs).toPandas()
        assert out["n_tokens"].sum() == sum(n for _, n in lengths)
        bins = out.groupby("bin_id").agg(used=("n_tokens", "sum"), capacity=("capacity", "first"))
        assert (bins["used"] <= bins["capacity"]).all() and set(bins["capacity"]) <= set(packing.CAPACITIES)
        smaller = dict(zip(packing.CAPACITIES, (0, *packing.CAPACITIES)))
        assert all(u > smaller[c] for u, c in bins.itertuples(index=False))
        for _, b in out.sort_values("bin_start").groupby("bin_id"):
            assert (b["bin_start"] + b["n_tokens"]).tolist()[:-1] <= b["bin_start"].tolist()[1:]
    assert packing.pack_documents(none).count() == 0
