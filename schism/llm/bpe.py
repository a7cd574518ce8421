"""BPE encoding and decoding (9): a priority queue of merge ranks over a doubly linked symbol list.

Stale queue entries (whose symbols have merged meanwhile) are skipped when they surface.  Decoding joins the
vocabulary strings of the ids.  Null and empty texts have no ids; very long texts are split at white space, which
no merge crosses, so memory follows the longest run without white space.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, texts
from .segments import SegmentCache, byte_alphabet, cached, normal_form, pretokens, split_column, split_texts


class Bpe:
    """A byte-level BPE with word ends, read from a tokenizers JSON file (its added tokens, pattern, vocabulary, merges)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[left], self.vocab[right]] = rank, self.vocab[left + right]
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(patterns[0])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if self.specials else lambda s: [s]
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.final = [self.vocab.get(c + self.suffix) for c in alphabet]
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        ids = [i for i in ids if i is not None]
        n, ranks = len(ids), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r[0], k, r[1], ids[k], ids[k + 1]) for k in range(n - 1) if (r := ranks.get((ids[k], ids[k + 1])))]
        heapq.heapify(queue)
        while queue:
            _, k, new, left, right = heapq.heappop(queue)
            j = after[k] if ids[k] == left else n
            if j >= n or ids[j] != right:
                continue  # stale
            ids[k], ids[j] = new, -1
            after[k] = end = after[j]
            if end < n:
                before[end] = k
                if r := ranks.get((new, ids[end])):
                    heapq.heappush(queue, (r[0], k, r[1], new, ids[end]))
            start = before[k]
            if start >= 0 and (r := ranks.get((ids[start], new))):
                heapq.heappush(queue, (r[0], start, r[1], ids[start], new))
        return tuple(i for i in ids if i >= 0)

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, from a bounded memory of late ones if it is there."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) > 60_000:
                self.words.clear()
            ids = self.words[word] = self.merge(word)
        return ids

    def encode_segment(self, segment: str) -> list[int]:
        if segment.isascii() and segment.isalpha():  # a single pre-token, that comes but once this way
            return list(self.merge(segment.lower()))
        out: list[int] = []
        for part in self.cut(segment):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                for w in pretokens(self.pattern, normal_form(part)):
                    out.extend(self.word(w))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for s in split_texts([text])[0] for i in self.encode_segment(s.decode("utf-8", "surrogatepass"))]

    def decode(self, ids) -> str:
        """Vocabulary strings of the ids, a space between them (the file names no decoder)."""
        return " ".join(self.strings[i] for i in ids)

    def both(self, segments: list[bytes]):
        """For each segment its ids as decimal text and its decoded text, as bytes."""
        for s in segments:
            ids = self.encode_segment(s.decode("utf-8", "surrogatepass"))
            yield " ".join(map(str, ids)).encode(), self.decode(ids).encode("utf-8", "surrogatepass")


def _digests(path: str):
    def run(batches):
        cache = cached(("bpe", path), lambda: SegmentCache(Bpe(path).both))
        for block in blocks(batches):
            texts = split_column(block.column("text"))
            known = cache.load(set().union(*texts))
            counts, ids, decoded = [], [], []
            for segments in texts:
                pairs = [known[s] for s in segments]
                line = b" ".join(filter(None, (p[0] for p in pairs)))
                counts.append(line.count(b" ") + 1 if line else 0)
                ids.append(hashlib.sha256(line).hexdigest())
                decoded.append(hashlib.sha256(b" ".join(filter(None, (p[1] for p in pairs)))).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, and sums of the ids and of the decoded text.  No shuffle."""
    return texts(docs).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids array<int>, decoded string."""

    def run(batches):
        bpe = Bpe(path)
        for block in blocks(batches):
            ids = [bpe.encode(t) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids])], ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
