"""Similarity of vectors and clusters of phrases (ids M5, M11, T8, T9, G12-G14)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most centres that may be broadcast; more are dealt in blocks.
BROADCAST_CENTRES = 20_000


def chunks(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Adds `chunk`, 0 to n - 1 in a total order, of sizes that differ by one at most; numbered range by range."""
    from .ranges import running_sum

    total = df.agg(F.count("*").alias("__n"))
    numbered = running_sum(df.withColumn("__one", F.lit(1)), order, "__one", "__i").crossJoin(F.broadcast(total))  # one row
    return numbered.withColumn("chunk", F.floor(F.col("__i") * n / F.col("__n")).cast("int")).drop("__one", "__i", "__n")


#: Blocks that similar vectors are dealt into while a block holds at most the second figure of rows.
BLOCKS, BLOCK_ROWS = 8, 32_768


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int = 2_000) -> DataFrame:
    """Pairs (a < b) of cosine at least the threshold: blocks of rows against blocks of rows, products of at most `block` rows each side.

    All pairs are compared (a threshold far from 1 leaves no sound filter), but only blocks are dealt and only pairs
    over the threshold leave a task.  A row is sent once for each block, so the blocks stay few and grow with the rows, up to BLOCK_ROWS.
    """
    n = vectors.count()
    parts = max(1, min(-(-n // block), BLOCKS), -(-n // BLOCK_ROWS))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("id", "v", "p", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))

    def run(tile: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(frame["v"].to_numpy())
        norm = np.sqrt((m * m).sum(1))
        ids, part = frame["id"].to_numpy(), frame["p"].to_numpy()
        first, second = np.flatnonzero(part == tile[0]), np.flatnonzero(part == tile[1])
        out = []
        for at in range(0, len(first), block):
            for to in range(0, len(second), block):
                a, b = first[at : at + block], second[to : to + block]
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = (m[a] @ m[b].T) / norm[a][:, None] / norm[b][None]
                i, j = np.nonzero(cosine >= threshold)
                x, y = ids[a[i]], ids[b[j]]
                ok = (x < y) if tile[0] == tile[1] else x != y
                out.append((np.minimum(x, y)[ok], np.maximum(x, y)[ok], cosine[i, j][ok]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [ids[:0], ids[:0], norm[:0]]
        return pd.DataFrame(dict(zip(("a", "b", "similarity"), columns)))

    return rows.groupBy("x", "y").applyInPandas(run, "a long, b long, similarity double")


def take_clusters(pairs: DataFrame, min_size: int = 3) -> DataFrame:
    """clusters = a head with its neighbours, by size (ties: smaller id), each member once, of at least min_size.

    Rounds of DataFrame steps until none is left: a head is taken when no larger (or equal and smaller-id) cluster shares a member.
    Returns head, member, similarity.
    """
    from ..sources.stages import stage

    pairs = stage(pairs, "pairs")  # read three times
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    near = pairs.select(F.col("a").alias("head"), F.col("b").alias("member"), "similarity").union(pairs.select("b", "a", "similarity")).union(ids.select("id", "id", F.lit(1.0)))
    left = stage(near.join(near.groupBy("head").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size), "head"), "clusters")
    out = None
    while not left.isEmpty():
        rank = F.struct((-F.col("size")).alias("s"), F.col("head").alias("h"))
        best = left.groupBy("member").agg(F.min(rank).alias("best"))
        blocked = left.join(best, "member").filter(F.col("best.h") != F.col("head")).select("head").distinct()
        taken = stage(left.join(blocked, "head", "left_anti"), "clusters")
        out = taken if out is None else out.unionByName(taken)
        gone = left.join(taken.select("member"), "member", "left_semi").select("head").distinct()
        left = stage(left.join(gone, "head", "left_anti"), "clusters")
    return (out if out is not None else left).select("head", "member", "similarity")


def reorder(clusters: DataFrame, threshold: float) -> DataFrame:
    """Members with cosine to the head over the threshold (strictly; the head itself stays), most similar first."""
    from pyspark.sql import Window

    w = Window.partitionBy("head").orderBy(F.desc("similarity"), "member")
    return clusters.filter((F.col("similarity") > threshold) | (F.col("head") == F.col("member"))).withColumn("pos", F.row_number().over(w) - 1)


def nearest_head(vectors: DataFrame, heads: DataFrame, threshold: float, block: int = 4_096, key: str = "vec_id") -> DataFrame:
    """Nearest head (head, v) of each vector at a cosine of at least the threshold, ties to the smaller head; vectors in blocks against blocks of heads."""
    kinds = dict(vectors.dtypes)[key], dict(heads.dtypes)["head"]
    vp, hp = max(1, -(-vectors.count() // block)), max(1, -(-heads.count() // block))
    a = vectors.select(key, F.col("embedding").cast("array<double>").alias("v")).withColumn("x", F.pmod(F.xxhash64(key), F.lit(vp))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(hp - 1))))
    b = heads.select("head", F.col("v").cast("array<double>").alias("v")).withColumn("y", F.pmod(F.xxhash64("head"), F.lit(hp))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(vp - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({key: left[key][:0], "head": right["head"][:0], "similarity": np.zeros(0)})
        right = right.sort_values("head", ignore_index=True)
        m, h = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.nan_to_num((m @ h.T) / np.sqrt((m * m).sum(1))[:, None] / np.sqrt((h * h).sum(1))[None], nan=-2)
        best = c.argmax(1)
        return pd.DataFrame({key: left[key], "head": right["head"].to_numpy()[best], "similarity": c[np.arange(len(c)), best]})

    each = a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInPandas(run, f"{key} {kinds[0]}, head {kinds[1]}, similarity double")
    top = each.groupBy(key).agg(F.min_by(F.struct("head", "similarity"), F.struct((-F.col("similarity")).alias("s"), "head")).alias("t"))
    return top.select(key, "t.*").filter(F.col("similarity") >= threshold)


def online_clusters(vectors: DataFrame, create: float = 0.8, assign: float = 0.75, min_size: int = 3, iterations: int = 10) -> DataFrame:
    """Clusters by threshold, then vectors to the nearest head, re-headed by centroid, until no membership changes.

    vectors: vec_id, embedding.  Deterministic: blocks by a hash of the id, ties by id.  Returns head, vec_id, similarity.
    """
    from ..functions.numbers import centroids
    from ..sources.stages import stage

    clusters = take_clusters(similar_pairs(vectors, create), min_size)
    heads = clusters.select("head").distinct().join(vectors.select(F.col("vec_id").alias("head"), F.col("embedding").alias("v")), "head")
    before = None
    for _ in range(iterations):
        found = stage(nearest_head(vectors, stage(heads, "heads"), assign), "assigned")
        big = found.groupBy("head").count().filter(F.col("count") >= min_size).select("head")
        found = stage(found.join(big, "head"), "assigned")
        if before is not None and found.select("vec_id", "head").exceptAll(before.select("vec_id", "head")).isEmpty():
            break
        before = found
        heads = centroids(found.join(vectors, "vec_id"), "head", "embedding").select("head", F.col("centroid").alias("v"))
    return found.select("head", "vec_id", "similarity")
