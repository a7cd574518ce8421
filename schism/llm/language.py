"""Language ID (8): averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean embedding of its words and their byte n-grams (2 to 4, with word borders); as the softmax is
linear, scoring adds up class scores of buckets.  Temperature and rejection threshold are calibrated on a fifth of
the sample.  The sample holds at most `per_language` documents of each language (those with the smallest hash of
doc_id and text among a share by that hash: a documented bound); scoring reads every text.

Defined cases: null, or no letter: `und`, score 0, rejected.  Null lang teaches nothing.  No labelled row: `und`.
Languages of equal score: the alphabetically first.  Repeated rows get the same result each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, PIECE, blocks, eights, leading, mix, spans, text_bytes, texts, word_hashes
from .quality import filtered

_NGRAMS = (2, 3, 4)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # [buckets, languages]: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def subwords(col: pa.Array, buckets: int):
    """(first word of each text, number of each word's kind, start of each kind's buckets, buckets): kinds are distinct words."""
    raw, offsets = text_bytes(col)
    raw = _LOWER[raw]
    starts, ends, first = spans(raw, offsets)
    _, index, kind = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    length = ends[index] - starts[index] + 2
    at = np.concatenate([[0], np.cumsum(length)])
    framed = np.full(at[-1], 1, np.uint8)
    inner = np.repeat(starts[index] - at[:-1] - 1, length) + np.arange(at[-1])
    edge = np.zeros(at[-1], bool)
    edge[at[:-1]] = edge[at[1:] - 1] = True
    framed[~edge] = raw[inner[~edge]]
    framed[at[:-1]] = 2
    view = eights(framed)
    owner = np.repeat(np.arange(len(index)), length)
    place, found = [np.arange(len(index))], [word_hashes(framed, at[:-1], at[1:])]
    for n in _NGRAMS:
        begin = np.arange(max(len(framed) - n + 1, 0))
        begin = begin[begin + n <= at[owner[begin] + 1]]
        found.append(mix(leading(view, begin, np.full(1, n)) + (np.uint64(n) << np.uint64(56))))
        place.append(owner[begin])
    place, found = np.concatenate(place), np.concatenate(found)
    order = np.argsort(place, kind="stable")
    return first, kind, np.searchsorted(place[order], np.arange(len(index) + 1)), ((found >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64)[order]


def _class_sums(col: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of class scores and number of subwords of each text."""
    first, kind, start, bucket = subwords(col, len(table))
    n = len(first) - 1
    if not len(bucket):
        return np.zeros((n, table.shape[1])), np.zeros(n)
    of_kind = np.add.reduceat(table[bucket], start[:-1])
    size = np.diff(start)
    total = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(of_kind[kind], 0)])
    count = np.concatenate([[0], np.cumsum(size[kind])])
    return total[first[1:]] - total[first[:-1]], count[first[1:]] - count[first[:-1]]


def sample(docs: DataFrame, buckets: int, per_language: int):
    """Bucket shares of sampled documents, as lists on the driver, with their languages."""
    own = docs.filter("lang is not null and text is not null and doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2")
    sizes = own.groupBy("lang").count().orderBy("lang").collect()  # one row per language
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return [], [], np.zeros(0, int)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.2 * per_language / r["count"])) for r in sizes], "lang string, share double")
    place = F.xxhash64("doc_id", "text")
    near = own.select("doc_id", "lang", "text", place.alias("place")).join(F.broadcast(shares), "lang").filter(F.pmod("place", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    first = Window.partitionBy("lang").orderBy("place", "doc_id", "text")  # of about 1.2 times the rows wanted, and repeated ones
    chosen = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= per_language).select("doc_id", "lang", "text")

    def run(batches):
        for block in blocks(batches, most=PIECE):
            first, kind, start, bucket = subwords(block.column("text"), buckets)
            for i in range(block.num_rows):
                kinds, times = np.unique(kind[first[i] : first[i + 1]], return_counts=True)
                size = start[kinds + 1] - start[kinds]
                total = np.repeat(times, size)
                at = np.repeat(start[kinds] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(kinds) else np.zeros(0, int)
                used, inverse = np.unique(bucket[at], return_inverse=True)
                weight = np.bincount(inverse, total, len(used)) if len(used) else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id").slice(i, 1), block.column("lang").slice(i, 1), pa.array([used.astype(np.int32)]), pa.array([(weight / max(weight.sum(), 1)).astype(np.float32)])],
                    ["doc_id", "lang", "bucket", "weight"],
                )

    table = chosen.mapInArrow(run, "doc_id long, lang string, bucket array<int>, weight array<float>").toArrow().sort_by("doc_id")
    lists = [(np.asarray(b.values), np.asarray(w.values)) for b, w in zip(table["bucket"], table["weight"]) if len(b.values)]
    ids = [languages.index(x) for x, b in zip(table["lang"].to_pylist(), table["bucket"]) if len(b.values)]
    return languages, lists, np.array(ids, int)


def fit(docs: DataFrame, buckets: int = 1 << 15, size: int = 12, per_language: int = 700, epochs: int = 4, rate: float = 1.0, lost: float = 0.001, seed: int = 5) -> Model:
    """Learn from documents (doc_id, text, lang) whose crc32(doc_id) mod 4 is not 2; lost: share of right ones that may be rejected."""
    languages, lists, target = sample(docs, buckets, per_language)
    if not lists:
        return Model([], np.zeros((buckets, 1)), np.zeros(1), 1.0, 1.1)
    random = np.random.default_rng(seed)
    embedding = (random.standard_normal((buckets, size)) / size).astype(np.float32)
    weight, bias = (random.standard_normal((size, len(languages))) * 0.5).astype(np.float32), np.zeros(len(languages), np.float32)
    order = random.permutation(len(lists))
    held, learn = order[: len(order) // 5], order[len(order) // 5 :]
    epochs = max(epochs, -(-300 // (len(learn) // 32 + 1)))  # more passes over a small sample
    steps, step = max(1, epochs * (len(learn) // 32 + 1)), 0
    for _ in range(epochs):
        for at in range(0, len(learn), 32):
            part = learn[at : at + 32]
            now = rate * (1 - step / steps)
            step += 1
            bucket = np.concatenate([lists[i][0] for i in part])
            share = np.concatenate([lists[i][1] for i in part])[:, None]
            ends = np.concatenate([[0], np.cumsum([len(lists[i][0]) for i in part])])
            mean = np.add.reduceat(embedding[bucket] * share, ends[:-1])
            logits = mean @ weight + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), target[part]] -= 1
            back = p @ weight.T
            weight -= now * mean.T @ p
            bias -= now * 0.1 * p.sum(0)
            np.add.at(embedding, bucket, (-now * 20 / len(part)) * share * np.repeat(back, np.diff(ends), 0))
        learn = random.permutation(learn)
    table = (embedding @ weight).astype(np.float64)
    use = held if len(held) else learn
    logits = np.stack([(table[lists[i][0]] * lists[i][1][:, None]).sum(0) for i in use]) + bias
    right = target[use]
    best = (np.inf, 1.0)
    for t in 2.0 ** np.arange(-5, 3.25, 0.25):  # the temperature of least held-out loss
        z = logits / t
        loss = (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), right]).mean()
        best = min(best, (loss, t))
    model = Model(languages, table, bias.astype(np.float64), float(best[1]), 0.0)
    p = model.probabilities(logits - bias, np.ones(len(use)))
    hit = p.max(1)[p.argmax(1) == right]
    model.threshold = float(min(0.5, np.quantile(hit, lost))) if len(hit) else 0.0
    return model


def _predict(block: pa.RecordBatch, model: Model):
    import regex

    letter = regex.compile(r"\p{L}").search
    has = np.array([bool(t) and letter(t) is not None for t in block.column("text").to_pylist()], bool)
    if not model.languages:
        return np.full(len(has), "und", object), np.zeros(len(has)), np.ones(len(has), bool)
    p = model.probabilities(*_class_sums(block.column("text"), model.scores))
    best = p.argmax(1)
    return np.where(has, np.array(model.languages, object)[best], "und"), np.where(has, p.max(1), 0.0), ~has | (p.max(1) < model.threshold)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, lang_pred, score, rejected.  The broadcast model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in blocks(batches, most=PIECE):
            names, best, rejected = _predict(block, shared.value)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(names, pa.string()), pa.array(best), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs, all columns, that aren't rejected; scored in place, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda block: ~_predict(block, shared.value)[2])
