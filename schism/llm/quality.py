"""Quality classifier (7): factorisation machine.

Hashed words, binned structure statistics and metadata (the length in characters) enter a model with low-rank pairwise interactions, scored in
linear time by sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2.  Fitted in numpy on the driver over at most
`max_rows` labelled rows (those with the smallest hash of doc_id: a documented bound); scoring reads every text.

Defined cases: null and empty texts have the statistics of an empty text and a score all the same; rows without a
label, id or text, or whose labels contradict each other, don't teach; of several documents of a labelled id the least
text teaches; with no labelled row at all every score is 0.5; repeated rows get the same score each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, PIECE, blocks, small_batches, spans, spread, text_bytes, word_hashes

#: Upper edges of the bins of each structure statistic.
_SHARES = (0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85, 0.95)
_SIZES = tuple(2.0**k for k in range(1, 16))
STATS = {
    "upper": _SHARES, "digit": _SHARES, "punctuation": _SHARES, "symbol": _SHARES, "bar": _SHARES, "other_bytes": _SHARES,
    "distinct_words": _SHARES, "most_frequent_word": _SHARES, "repeated_next": _SHARES, "long_words": _SHARES, "short_words": _SHARES,
    "upper_words": _SHARES, "marked_words": _SHARES, "words": _SIZES, "lines": _SIZES, "mean_word": tuple(0.75 * k for k in range(3, 18)),
    "chars": tuple(8.0 * x for x in _SIZES),
}
#: The metadata column that is an input: the length in characters as its source gives it; null, or no such column: counted.
METADATA = "n_chars"
_BINS = 16
#: Byte kinds.
_KIND = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in {"digit": b"0123456789", "punctuation": b".,;:!?'\"()-", "symbol": b"*$#%&@^~_=+<>{}[]\\/", "bar": b"|"}.items()}
_KIND |= {"upper": np.isin(np.arange(256), np.arange(65, 91)), "lower": np.isin(np.arange(256), np.arange(97, 123)), "other_bytes": np.arange(256) >= 128}


@dataclass
class Machine:
    """bias, weights [features] and factors [features, rank]; the last len(STATS)*16 features are binned statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    buckets: int

    def score(self, rows: np.ndarray, features: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Probability for each of n rows; rows is sorted and holds every row."""
        return 1 / (1 + np.exp(-np.clip(self.margin(rows, features, values, n)[0], -30, 30)))

    def margin(self, rows, features, values, n):
        at = np.searchsorted(rows, np.arange(n))
        vx = self.factors[features] * values[:, None]
        sums = np.add.reduceat(vx, at)
        linear = np.add.reduceat(self.weights[features] * values, at)
        return self.bias + linear + 0.5 * (sums**2 - np.add.reduceat(vx**2, at)).sum(1), vx, sums


def _per_row(weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of an array between consecutive starts."""
    total = np.concatenate([[0.0], np.cumsum(weights, dtype=np.float64)])
    return np.diff(total[starts])


def with_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, text and the metadata column of documents."""
    given = F.col(METADATA).cast("long") if METADATA in docs.columns else F.lit(None).cast("long")
    return spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", given.alias(METADATA))


def features(col: pa.Array, buckets: int, chars: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of every text, by row: unit-length hashed words, then one bin of each statistic and of the metadata."""
    raw, offsets = text_bytes(col)
    n = len(offsets) - 1
    low = _LOWER[raw]
    starts, ends, first = spans(low, offsets)
    size, words = np.maximum(np.diff(offsets), 1), np.diff(first)
    per_word = np.maximum(words, 1)
    hashes = word_hashes(low, starts, ends)
    bucket = (hashes & np.uint64(buckets - 1)).astype(np.int64)
    key, count = np.unique(np.repeat(np.arange(n), words) * buckets + bucket, return_counts=True)
    rows, feature = key // buckets, key % buckets
    value = 1 + np.log(count)
    distinct = np.bincount(rows, minlength=n)
    value /= np.sqrt(np.bincount(rows, value**2, n))[rows]
    most = np.zeros(n)
    np.maximum.at(most, rows, count)
    length = ends - starts
    same = np.zeros(len(hashes))
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][words > 0]] = 0
    stat = {k: _per_row(_KIND[k][raw], offsets) / size for k in ("upper", "digit", "punctuation", "symbol", "bar", "other_bytes")}
    letters = np.maximum(_per_row((_KIND["upper"] | _KIND["lower"])[raw], offsets), 1)
    stat["upper"] = stat["upper"] * size / letters
    odd = np.concatenate([[0], np.cumsum((_KIND["symbol"] | _KIND["bar"])[raw] | (raw == 33))])
    capital = np.concatenate([[0], np.cumsum(_KIND["upper"][raw])])
    stat |= {"distinct_words": distinct / per_word, "most_frequent_word": most / per_word, "repeated_next": _per_row(same, first) / per_word}
    stat |= {"long_words": _per_row(length > 14, first) / per_word, "short_words": _per_row(length < 3, first) / per_word}
    stat |= {"upper_words": _per_row(capital[ends] - capital[starts] > 1, first) / per_word, "marked_words": _per_row(odd[ends] > odd[starts], first) / per_word}
    stat |= {"words": words, "lines": _per_row(raw == 10, offsets) + 1, "mean_word": _per_row(length, first) / per_word}
    counted = _per_row((raw & 0xC0) != 0x80, offsets)  # all bytes but continuations
    stat["chars"] = counted if chars is None else np.where(chars.is_null().to_numpy(zero_copy_only=False), counted, chars.fill_null(0).to_numpy())
    bins = np.stack([np.digitize(stat[k], edges) for k, edges in STATS.items()], 1) + np.arange(len(STATS)) * _BINS + buckets
    row = np.concatenate([rows, np.repeat(np.arange(n), len(STATS))])
    order = np.argsort(row, kind="stable")
    value = np.concatenate([value, np.full(n * len(STATS), 0.5)])
    return row[order], np.concatenate([feature, bins.ravel()])[order], value[order]


def training_rows(docs: DataFrame, labels: DataFrame, buckets: int, max_rows: int) -> tuple[list, np.ndarray]:
    known = labels.filter("quality is not null and doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"), F.max(F.col("quality").cast("int")).alias("other"))
    chosen = known.filter("label = other").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches):
        for block in blocks(batches, most=PIECE):
            row, feature, value = features(block.column("text"), buckets, block.column(METADATA))
            ends = np.searchsorted(row, np.arange(block.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("label"), pa.ListArray.from_arrays(ends, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))],
                ["doc_id", "label", "feature", "value"],
            )

    rows = with_metadata(docs).filter("text is not null").join(F.broadcast(chosen), "doc_id")  # max_rows at most
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct("text", METADATA)).alias("least")).select("doc_id", "label", "least.*")  # one row an id
    table = rows.mapInArrow(run, "doc_id long, label int, feature array<int>, value array<float>").toArrow().sort_by("doc_id")
    lists = [(np.asarray(f.values), np.asarray(v.values)) for f, v in zip(table["feature"], table["value"])]
    return lists, table["label"].to_numpy().astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 17, rank: int = 6, max_rows: int = 12_000, epochs: int = 4, batch: int = 64, steps: int = 800, rate: float = 0.2, seed: int = 7) -> Machine:
    """Adagrad over the logistic loss of at most max_rows labelled rows whose crc32(doc_id) mod 5 is not 0.

    At least `epochs` passes, and more over few rows until `steps` steps are made."""
    lists, labels_ = training_rows(docs, labels, buckets, max_rows)
    random = np.random.default_rng(seed)
    size = buckets + len(STATS) * _BINS
    model = Machine(0.0, np.zeros(size, np.float32), (random.standard_normal((size, rank)) * 0.02).astype(np.float32), buckets)
    if not len(labels_):
        model.factors[:] = 0
        return model
    seen_w, seen_v = np.full(size, 1e-3, np.float32), np.full((size, rank), 1e-3, np.float32)
    seen_b = 1e-3
    for _ in range(max(epochs, -(-steps * batch // len(lists)))):
        order = random.permutation(len(lists))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            feature = np.concatenate([lists[i][0] for i in part])
            value = np.concatenate([lists[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(lists[i][0]) for i in part])
            margin, vx, sums = model.margin(row, feature, value, len(part))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels_[part]) / len(part)
            each = (error[row] * value)[:, None].astype(np.float32)
            used, inverse = np.unique(feature, return_inverse=True)
            by_feature = np.argsort(inverse, kind="stable")
            edges = np.searchsorted(inverse[by_feature], np.arange(len(used)))
            grad_v = np.add.reduceat((each * (sums[row] - vx))[by_feature], edges) + 1e-6 * model.factors[used]
            grad_w = np.add.reduceat(each[by_feature, 0], edges) + 1e-6 * model.weights[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += error.sum() ** 2
            model.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            model.factors[used] -= 0.3 * rate * grad_v / np.sqrt(seen_v[used])
            model.bias -= rate * error.sum() / np.sqrt(seen_b)
    return model


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, score.  The broadcast model has a fixed size (buckets x (rank + 1) floats)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in blocks(batches, most=PIECE):
            found = shared.value.score(*features(block.column("text"), shared.value.buckets, block.column(METADATA)), block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(found.astype(np.float64))], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return with_metadata(docs).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Machine, least: float = 0.3) -> DataFrame:
    """Rows of docs, all columns, whose text scores at least `least`; scored in place, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def wanted(block: pa.RecordBatch) -> np.ndarray:
        chars = block.column(METADATA).cast(pa.int64()) if METADATA in block.schema.names else None
        return shared.value.score(*features(block.column("text"), shared.value.buckets, chars), block.num_rows) >= least

    return filtered(docs, wanted)


def filtered(docs: DataFrame, wanted) -> DataFrame:
    """Rows of docs, all columns as they were, for which `wanted` (a block of rows to a boolean array) holds."""
    small_batches(docs.sparkSession)
    keep, null = (next(n for n in (f"{base}{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("keep_", "null_"))
    plain = spread(docs).withColumn(null, F.col("text").isNull())

    def run(batches):
        for block in blocks(batches, most=PIECE):
            yield _utf8(pa.RecordBatch.from_arrays([pa.array(wanted(block))] + block.columns, [keep] + block.schema.names))

    schema = f"`{keep}` boolean, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, schema).filter(F.col(keep)).withColumn("text", F.when(~F.col(null), F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def _utf8(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, "text", batch.column(at).cast(pa.string()))
