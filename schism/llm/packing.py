"""Best-fit packing (2) with variable capacity.

Several sequence lengths are permitted and chosen jointly: a piece goes to the open bin with the least room that
holds it; else the bin size of least net cost is opened (its cost less what the room left over is worth, at the
lowest cost per token and the fill reached so far); at the end every bin shrinks to the smallest permitted length
that holds its contents.  Documents longer than the largest length are cut into pieces of it.  Documents are dealt
by a hash of doc_id into shards of about `shard_rows`, packed one by one: at most one bin of each length per shard
stays less full than in a single run.

Defined cases: null or empty text is one token (the end token); null doc_id is packed like another; repeated rows
are packed each; an empty table gives no bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_counts
from .common import blocks, spans, stage, text_bytes, texts

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Fixed cost of a sequence beside its tokens, in tokens.
OVERHEAD = 32
SCHEMA = "doc_id long, piece int, doc_start long, n_tokens int, bin_id string, capacity int, bin_start int, bin_pieces int, bin_tokens int"


def cost(capacity: int) -> float:
    return capacity + OVERHEAD


def pack(sizes, capacities=CAPACITIES, cost=cost) -> tuple[list[int], list[int], list[int]]:
    """Best fit, largest first.  Returns bin of each size (in the given order), start in the bin, capacity of each bin."""
    capacities = sorted(capacities)
    cheapest = min(cost(c) / c for c in capacities)
    place, start = [0] * len(sizes), [0] * len(sizes)
    room: list[int] = []
    used: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    mask = 0  # bit r: some open bin has room r
    left, filled = 1.0, 1.0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                mask &= ~(1 << r)
            filled += size
        else:
            worth = cheapest * min(1.0, filled / left)
            r = min((c for c in capacities if c >= size), key=lambda c: (cost(c) - worth * (c - size), c))
            b = len(room)
            room.append(r)
            used.append(0)
            left += r - size
        place[i], start[i] = b, used[b]
        used[b] += size
        room[b] = r - size
        if room[b]:
            open_bins[room[b]].append(b)
            mask |= 1 << room[b]
    return place, start, [next(c for c in capacities if c >= u) for u in used]


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens: words (runs of bytes other than space and 09-0D) and one end token."""

    def run(batches):
        for block in blocks(batches):
            _, _, first = spans(*text_bytes(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(first).astype(np.int64) + 1)], ["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long")


def pack_lengths(lengths: DataFrame, capacities=CAPACITIES, cost=cost, shard_rows: int = 50_000) -> DataFrame:
    """One row per piece of each row of lengths (doc_id, n_tokens): its bin, the bin's final capacity, its place there."""
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    lengths = stage(lengths, "pack-lengths")
    shards = max(1, -(-lengths.count() // shard_rows))
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.greatest("n_tokens", F.lit(1)) - 1) / largest).cast("int"))))
    pieces = pieces.select(
        "doc_id", "piece", (F.col("piece").cast("long") * largest).alias("doc_start"), F.least(F.col("n_tokens") - F.col("piece") * largest, F.lit(largest)).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int").alias("shard"),
    )

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "n_tokens"], kind="stable", ignore_index=True)
        place, start, sizes = pack(frame["n_tokens"].tolist(), capacities, cost)
        place = np.array(place)
        pieces, tokens = np.bincount(place), np.bincount(place, frame["n_tokens"]).astype(np.int32)
        return frame.drop(columns="shard").assign(bin_id=[f"{key[0]}-{b}" for b in place], capacity=np.array(sizes)[place], bin_start=start, bin_pieces=pieces[place], bin_tokens=tokens[place])

    return pieces.groupBy("shard").applyInPandas(run, SCHEMA)


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and n_tokens: pieces of a sentencepiece vocabulary and one end token."""
    return token_counts.counts(docs, tokenizer, cover=True).select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Documents in sequences: lengths in tokens of a tokenizer's vocabulary file, or in words without one."""
    return pack_lengths(token_lengths(docs, tokenizer) if tokenizer else word_lengths(docs), **options)
