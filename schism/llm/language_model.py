"""LM scoring (1): Elias-Fano n-gram tries, one per shard of context words.

1. One scan turns texts into blocks of local word numbers and asks vocabulary shards for counts.
2. A vocabulary shard adds up counts; words are numbered by descending count code, so a word's number gives its
   (quantised) count anywhere without a table of words.
3. Each block sends its positions (u, v, w, document) to the shard of the context word v.  Positions whose context
   word isn't in the training text have the unigram probability and stay.  So do those of a hot context, with over
   `shard_positions / 4` positions: the block asks for the counts of their different (u, v, w), (u, v) and (v, w), each
   at the shard of its own hash with what the block adds to it.  A shard has at most one row per n-gram and block, so
   none grows with one word, pair or triple, and every probability uses all training rows.
4. A shard of positions builds the trie of its training positions, writes it to a file, maps that file, answers all
   its positions and returns one sum per document; a shard of n-grams adds up the counts and returns them to each block.
5. A block, met once more with its word numbers, adds the parts.

Trigram model with Dirichlet smoothing: p(w|u,v) = (c(uvw) + m3 p(w|v)) / (c(uv) + m3), p(w|v) likewise with m2,
p(w) = (c(w) + 1) / (N + V + 1).  Parts of probabilities are quantised in steps of 0.0005 in log10.

Defined cases: null and empty texts are the end token alone; a null doc_id hashes as empty text; repeated rows are
documents each; with no training row every token has probability 1 / (0 + 0 + 1).
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_mod, lower_words, mix, narrow, pack, partitions, release, released, small_reads, stage, stage_small, texts, unpack
from .elias_fano import Trie

_END = np.uint64(0x5EED0E0D0E0D5EED)
#: Positions in a block, and most vocabulary shards (their table of 8 bytes a count code and shard is broadcast).
BLOCK_POSITIONS, VOCABULARY_SHARDS = 1_500_000, 1024
#: Sums of log10 probabilities travel as whole numbers of this many to one.
_UNITS = 1e9
#: Lower bounds of count codes: exact to 64, then in steps of 2 %.
_COUNTS = np.unique(np.concatenate([np.arange(65), np.floor(64 * 1.02 ** np.arange(1, 1400)).astype(np.int64)]))


def _join(parts) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _scratch() -> str | None:
    """A folder for a task's own file, which is gone before the task ends: the executor's local folder where Spark names one."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)


def _rows(names: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names.split())


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (a, b) its number among the different ones, and for each of these the place of one; any 64-bit integers."""
    x, y = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    _, place, number = np.unique(x.astype(np.int64) * (int(y.max()) + 1 if len(y) else 1) + y, return_index=True, return_inverse=True)
    return number, place


def _grams(u: np.ndarray, v: np.ndarray, w: np.ndarray, train: np.ndarray, shards: int):
    """Different n-grams of positions as three numbers (u, v, w + 2; u, v, 0; v, w, 1), training counts, order by shard, shards'
    edges in it, and for each position the places of its (u, v, w), (u, v) and (v, w)."""
    ctx, at_ctx = _pairs(u, v)
    succ, at_succ = _pairs(v, w)
    leaf, at_leaf = _pairs(ctx, w)
    first = np.concatenate([u[at_leaf], u[at_ctx], v[at_succ]])
    second = np.concatenate([v[at_leaf], v[at_ctx], w[at_succ]])
    third = np.concatenate([w[at_leaf] + 2, np.zeros(len(at_ctx), np.int64), np.ones(len(at_succ), np.int64)])
    learned = np.concatenate([np.bincount(i[train], minlength=len(k)) for i, k in ((leaf, at_leaf), (ctx, at_ctx), (succ, at_succ))])
    shard = (mix(mix(mix(first.astype(np.uint64)) + second.astype(np.uint64)) + third.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable").astype(np.int32)
    return (first, second, third, learned), order, np.searchsorted(shard[order], np.arange(shards + 1)), (leaf, len(at_leaf) + ctx, len(at_leaf) + len(at_ctx) + succ)


class _Block:
    """A block's positions with their word numbers and counts."""

    def __init__(self, data: bytes, replies: pd.DataFrame, starts: np.ndarray, hot: int):
        self.ids, self.null, self.lengths, train, number = (unpack(p) for p in _split(data))
        learned, total, place = [], [], []
        for shard, reply in sorted(zip(replies["shard"], replies["data"])):
            c, t, p = (unpack(x).astype(np.int64) for x in _split(reply))
            learned.append(c)
            total.append(t)
            place.append(p + starts[np.searchsorted(_COUNTS, c, "right") - 1, shard])
        learned, total, place = narrow(np.concatenate(learned)), np.concatenate(total), np.concatenate(place)
        self.train = train.astype(bool)
        ends = np.cumsum(self.lengths)
        self.first = first = ends - self.lengths
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)
        self.count = learned[number]
        self.w = narrow(place)[number]
        end = number[ends[0] - 1]  # documents in all: positions with number 0 before them
        before = lambda x, start: self._before(x, start, first)
        self.v = before(self.w, 0)
        self.u = before(self.v, 0)
        self.context_count = before(self.count, learned[end])
        seen = self.context_count > 0
        self.alone = np.flatnonzero(~seen)
        often = seen & (before(total[number], total[end]) > hot)
        self.hot, self.cold = np.flatnonzero(often), np.flatnonzero(seen & ~often)

    @staticmethod
    def _before(x: np.ndarray, start: int, first: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[first] = start
        return out

    def grams(self, shards: int):
        i = self.hot
        u, v, w = (x[i].astype(np.int64) for x in (self.u, self.v, self.w))
        return _grams(u, v, w, self.train[self.doc[i]], shards)


class _Model:
    def __init__(self, docs: DataFrame, held_modulus: int, held_remainder: int, mu2: float, mu3: float, shard_positions: int):
        self.docs = texts(docs)
        self.spark = docs.sparkSession
        small_reads(self.spark)
        self.held, self.mu2, self.mu3, self.shard_positions = (held_modulus, held_remainder), mu2, mu3, shard_positions
        self.bits = max(1, min((partitions(self.spark) - 1).bit_length(), VOCABULARY_SHARDS.bit_length() - 1))

    def scan(self) -> DataFrame:
        """kind 0: a block (ids, lengths, words as numbers into its sorted hashes); kind 1: a block's questions to a vocabulary shard."""
        bits, (modulus, remainder) = self.bits, self.held

        def out(block: int, held: list):
            ids = pa.concat_arrays([h[0] for h in held])
            words, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            train = crc_mod(ids.to_pylist(), modulus) != remainder
            kinds, number = np.unique(words, return_inverse=True)
            total = np.bincount(number, minlength=len(kinds))
            learned = np.bincount(number, np.repeat(train, lengths), len(kinds)).astype(np.int64)
            whole = _join([pack(ids.fill_null(0).to_numpy()), pack(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)), pack(lengths), pack(train.astype(np.uint8)), pack(narrow(number))])
            edges = np.searchsorted(kinds >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            full = [s for s in range(1 << bits) if edges[s + 1] > edges[s]]
            asked = [_join([pack(np.diff(kinds[i:j], prepend=np.uint64(0))), pack(narrow(learned[i:j])), pack(narrow(total[i:j]))]) for i, j in ((edges[s], edges[s + 1]) for s in full)]
            n = len(full) + 1
            return pa.RecordBatch.from_arrays([pa.array([0] + [1] * len(full), pa.int32()), pa.array([block] * n, pa.int64()), pa.array([-1] + full, pa.int32()), pa.array([whole] + asked, pa.binary())], ["kind", "block", "shard", "data"])

        def run(batches):
            with np.errstate(over="ignore"):
                held, size, block = [], 0, TaskContext.get().partitionId() << 32
                for part in blocks(batches):
                    words, first = lower_words(part.column("text"))
                    words = np.insert(words, first[1:], _END)
                    held.append((part.column("doc_id"), words, np.diff(first) + 1))
                    size += len(words)
                    if size > BLOCK_POSITIONS:
                        yield out(block, held)
                        held, size, block = [], 0, block + 1
                if held:
                    yield out(block, held)
            del held
            release()

        return stage(self.docs.mapInArrow(run, "kind int, block long, shard int, data binary"), "lm-blocks")

    def vocabulary(self, questions: DataFrame) -> DataFrame:
        """Answers per block and shard: counts, totals, and place among the shard's words of the same count code; and a summary (block null)."""

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            parts = [[unpack(p) for p in _split(d)] for d in frame["data"]]
            with np.errstate(over="ignore"):
                hashes = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
            kinds, number = np.unique(np.concatenate(hashes), return_inverse=True)
            learned = np.bincount(number, np.concatenate([p[1] for p in parts]), len(kinds)).astype(np.int64)
            total = np.bincount(number, np.concatenate([p[2] for p in parts]), len(kinds)).astype(np.int64)
            code = np.searchsorted(_COUNTS, learned, "right") - 1
            order = np.argsort(code, kind="stable")
            sizes = np.bincount(code, minlength=len(_COUNTS))
            place = np.empty(len(kinds), np.int64)
            place[order] = np.arange(len(kinds)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            shard, out, at = int(frame["shard"].iloc[0]), [], 0
            for block, h in zip(frame["block"], hashes):
                mine = number[at : at + len(h)]
                at += len(h)
                out.append((block, shard, _join([pack(narrow(x[mine])) for x in (learned, total, place)]), 0, 0))
            out.append((None, shard, pack(narrow(sizes)), int((learned > 0).sum()), int(learned.sum())))
            return _rows("block shard data kinds tokens", out)

        return stage_small(questions.groupBy("shard").applyInPandas(released(run), "block long, shard int, data binary, kinds long, tokens long"), "lm-vocabulary")

    def numbering(self, answers: DataFrame) -> None:
        """First word number of every count code and shard (a table of fixed most size), corpus totals."""
        rows = answers.filter("block is null").select("shard", "data", "kinds", "tokens").collect()  # one per vocabulary shard
        sizes = np.zeros((len(_COUNTS), 1 << self.bits), np.int64)
        for r in rows:
            sizes[:, r["shard"]] = unpack(bytes(r["data"]))
        down = sizes[::-1].ravel()
        starts = (1 + np.cumsum(down) - down).reshape(sizes.shape)[::-1].copy()  # number 0: before the first word
        self.kinds, self.tokens = sum(r["kinds"] for r in rows), sum(r["tokens"] for r in rows)
        self.starts = starts
        self.code_start = starts[:, 0].copy()  # descending with the code

    def run(self) -> DataFrame:
        scanned = self.scan()
        answers = self.vocabulary(scanned.filter("kind = 1").select("block", "shard", "data"))
        self.numbering(answers)
        bits, starts, code_start, kinds, tokens = self.bits, self.starts, self.code_start, self.kinds, self.tokens
        shared = self.spark.sparkContext.broadcast((starts, code_start))
        hot = max(1, self.shard_positions // 4)
        shards = max(partitions(self.spark), -(-tokens // self.shard_positions))
        mu2, mu3 = self.mu2, self.mu3
        denominator = float(tokens + kinds + 1)

        def base(numbers: np.ndarray) -> np.ndarray:
            """p(w) of word numbers, by their count code."""
            ascending = shared.value[1][::-1]
            code = len(ascending) - np.searchsorted(ascending, numbers, "right")
            return (_COUNTS[np.clip(code, 0, len(_COUNTS) - 1)] + 1) / denominator

        def ask(block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            """A block's positions for each trie shard, its n-grams of hot contexts for each n-gram shard (numbered after those)."""
            at, b = int(block["block"].iloc[0]), _Block(block["data"].iloc[0], replies, shared.value[0], hot)
            out = []
            shard = (mix(b.v[b.cold].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edges)):
                i = b.cold[order[edges[s] : edges[s + 1]]]
                sent = [b.v[i], b.u[i], b.w[i], narrow(np.diff(b.doc[i], prepend=0)), np.packbits(b.train), np.array([len(b.ids)])]
                out.append((int(s), at, _join([pack(x) for x in sent])))
            columns, order, edges, _ = b.grams(shards)
            for s in np.flatnonzero(np.diff(edges)):
                i = order[edges[s] : edges[s + 1]]
                out.append((shards + int(s), at, _join([pack(narrow(x[i])) for x in columns])))
            return _rows("shard block data", out)

        def ask_block(block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            with np.errstate(over="ignore"):
                out = ask(block, replies)
            release()
            return out

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            """Counts of n-grams over all blocks, for each block that asked."""
            parts = [[unpack(p) for p in _split(d)] for d in frame["data"]]
            first, second, third, learned = (np.concatenate([p[k].astype(np.int64) for p in parts]) for k in range(4))
            number = _pairs(_pairs(first, second)[0], third)[0]
            total = np.bincount(number, learned).astype(np.int64)[number]
            ends = np.cumsum([len(p[0]) for p in parts])
            return frame[["block", "shard"]].assign(data=[pack(narrow(x)) for x in np.split(total, ends[:-1])])

        def answer(frame: pd.DataFrame) -> pd.DataFrame:
            """Sums of log10 probabilities per document, for each block with positions in this shard."""
            columns, sizes, spans = [], [], []
            for data in frame["data"]:
                v, u, w, doc, train, n = (unpack(p) for p in _split(data))
                doc = np.cumsum(doc.astype(np.int64))
                train = np.unpackbits(train)[: int(n[0])].astype(bool)[doc]
                columns.append((*(x.astype(np.int64) if x.dtype == np.uint64 else x for x in (v, u, w)), doc.astype(np.int32), train))
                sizes.append(int(n[0]))
                spans.append(len(v))
            v, u, w, doc, train = (np.concatenate(x) for x in zip(*columns))
            del columns
            trie = Trie.build(u[train], v[train], w[train], mu2, mu3)
            fd, path = tempfile.mkstemp(suffix=".trie", dir=_scratch())
            os.close(fd)
            try:
                trie.save(path)
                trie = Trie.load(path)
                log = np.empty(len(v))
                for at in range(0, len(v), 1 << 18):
                    a, g = trie.interpolation(u[at : at + (1 << 18)], v[at : at + (1 << 18)], w[at : at + (1 << 18)])
                    log[at : at + (1 << 18)] = np.minimum(np.log10(a + g * base(w[at : at + (1 << 18)])), 0.0)  # codes are rounded
            finally:
                os.unlink(path)
            out, at = [], 0
            for block, shard, n, span in zip(frame["block"], frame["shard"], sizes, spans):
                sums = np.bincount(doc[at : at + span], log[at : at + span], n)
                at += span
                out.append((block, shard, pack(narrow(np.rint(sums * -_UNITS).astype(np.int64)))))
            return _rows("block shard data", out)

        def finish(block: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            b = _Block(block["data"].iloc[0], parts[parts["kind"] == 0], shared.value[0], hot)
            parts = parts[parts["kind"] == 1].sort_values("shard")
            logs = np.log10(b.count + 1.0)
            basis = np.add.reduceat(logs, b.first) - b.lengths * np.log10(denominator)
            known = np.add.reduceat((b.count > 0).astype(np.int64), b.first)
            n = len(b.ids)
            score = np.bincount(b.doc[b.alone], logs[b.alone] - np.log10(denominator), n).astype(np.float64)
            for data in parts["data"][parts["shard"] < shards]:
                score -= unpack(data) / _UNITS
            if len(b.hot):
                *_, order, _, (leaf, ctx, succ) = b.grams(shards)
                found = np.empty(len(order))
                found[order] = np.concatenate([unpack(d) for d in parts["data"][parts["shard"] >= shards]])
                low = (found[succ] + mu2 * (b.count[b.hot] + 1) / denominator) / (b.context_count[b.hot] + mu2)
                score += np.bincount(b.doc[b.hot], np.log10((found[leaf] + mu3 * low) / (found[ctx] + mu3)), n)
            doc_id = pd.Series(b.ids).astype("Int64").mask(b.null > 0)
            return pd.DataFrame({"doc_id": doc_id.astype(object).where(b.null == 0, None), "held_out": ~b.train, "n_tokens": b.lengths.astype(np.int64), "n_known": known, "train_tokens": np.full(n, tokens), "base_score": basis, "score": score})

        def finish_block(block: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            with np.errstate(over="ignore"):
                out = finish(block, parts)
            release()
            return out

        def answer_shard(frame: pd.DataFrame) -> pd.DataFrame:
            out = add(frame) if frame["shard"].iloc[0] >= shards else answer(frame)
            release()
            return out

        own = scanned.filter("kind = 0").select("block", "data")
        replies = answers.filter("block is not null").select("block", "shard", "data")
        asked = own.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(ask_block, "shard int, block long, data binary")
        sums = asked.groupBy("shard").applyInPandas(answer_shard, "block long, shard int, data binary")
        parts = replies.withColumn("kind", F.lit(0)).unionByName(sums.withColumn("kind", F.lit(1)))
        return own.groupBy("block").cogroup(parts.groupBy("block")).applyInPandas(finish_block, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, held_modulus: int = 7, held_remainder: int = 2, mu2: float = 200.0, mu3: float = 4.0, shard_positions: int = 1_000_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) modulo held_modulus is not held_remainder, scores all.
    """
    return _Model(docs, held_modulus, held_remainder, mu2, mu3, shard_positions).run()
