"""Approximate nearest neighbours (5): a vantage-point tree per shard.

Shards are dealt by a hash of vec_id, so no shard depends on the data's clusters.  Each tree is built once and staged
as a row of bytes.  Queries go in groups of bounded size (a broadcast of at most GROUP_BYTES) past all trees; a task
carries the k best found so far from tree to tree, so the later ones are pruned by the current k-th distance.  A
subtree is skipped when the triangle inequality puts it at least `factor` times that distance away: factor one is
exact, less prunes more.  Every row is indexed; the k best of each task are merged.

Defined cases: vectors that are null, zero, or with null or non-finite components take no part, nor those of another
length than most of the rest have (of lengths as common the smallest); repeated rows are candidates each; ties go to
the smaller vec_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, release, small_batches, stage

#: Most bytes of the queries that are broadcast at a time.
GROUP_BYTES = 32 << 20
_NONE = np.iinfo(np.int64).max


class VantageTree:
    """Points halved by their distance to a vantage point until `leaf` remain.

    Arrays: node k is a leaf of the points order[low:high] where centre is -1; else low and high are its inner and
    outer child, reach the distance of the farthest inner and start that of the nearest outer point."""

    FIELDS = ("ids", "points", "order", "centre", "low", "high", "reach", "start")

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = 128):
        self.ids, self.points = ids, points
        nodes, order = [], []

        def grow(members: np.ndarray) -> int:
            me = len(nodes)
            nodes.append(None)
            if len(members) <= leaf:
                at = sum(map(len, order))
                order.append(members)
                nodes[me] = (-1, at, at + len(members), 0.0, 0.0)
                return me
            centre = members[len(members) // 2]
            rest = members[members != centre]
            away = distances(points[centre][None], points[rest])[0]
            rank = np.argsort(away, kind="stable")
            near, far = rank[: len(rest) // 2], rank[len(rest) // 2 :]
            inside, outside = grow(rest[np.sort(near)]), grow(rest[np.sort(far)])
            nodes[me] = (centre, inside, outside, away[near[-1]], away[far[0]])
            return me

        if len(ids):
            grow(np.argsort(ids, kind="stable"))
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        columns = list(zip(*nodes)) or [()] * 5
        self.centre, self.low, self.high = (np.array(c, np.int64) for c in columns[:3])
        self.reach, self.start = (np.array(c, np.float64) for c in columns[3:])

    def dumps(self) -> bytes:
        out = []
        for name in self.FIELDS:
            array = np.ascontiguousarray(getattr(self, name))
            head = f"{array.dtype.str} {' '.join(map(str, array.shape))}".encode().ljust(48)
            out.append(head + len(array.tobytes()).to_bytes(8, "little") + array.tobytes())
        return b"".join(out)

    @classmethod
    def loads(cls, data: bytes) -> VantageTree:
        tree, at = cls.__new__(cls), 0
        for name in cls.FIELDS:
            kind, *shape = data[at : at + 48].decode().split()
            size = int.from_bytes(data[at + 48 : at + 56], "little")
            setattr(tree, name, np.frombuffer(data, np.dtype(kind), size // np.dtype(kind).itemsize, at + 56).reshape([int(n) for n in shape]))
            at += 56 + size
        tree.points = tree.points.astype(np.float64)
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, best: np.ndarray | None = None, found: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest of each query, nearest first, among the points and those given as found before."""
        self.best = np.full((len(queries), k), np.inf) if best is None else best
        self.found = np.full((len(queries), k), _NONE) if found is None else found
        self.queries, self.own, self.factor = queries, own, factor
        if len(self.centre):
            self._visit(0, np.arange(len(queries)))
        return self.best, self.found

    def _offer(self, active: np.ndarray, members: np.ndarray, away: np.ndarray) -> None:
        away = np.where(self.ids[members][None] == self.own[active][:, None], np.inf, away)
        some = (away <= self.best[active, -1][:, None]) & np.isfinite(away)
        k = self.best.shape[1]
        for row in np.flatnonzero(some.any(1)):
            q, mine = active[row], np.flatnonzero(some[row])
            d = np.concatenate([self.best[q], away[row, mine]])
            names = np.concatenate([self.found[q], self.ids[members[mine]]])
            top = np.lexsort((names, d))[:k]
            self.best[q], self.found[q] = d[top], names[top]

    def _visit(self, node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        centre, low, high = self.centre[node], self.low[node], self.high[node]
        if centre < 0:
            members = self.order[low:high]
            for at in range(0, len(active), 64):
                part = active[at : at + 64]
                self._offer(part, members, distances(self.queries[part], self.points[members]))
            return
        reach, start = self.reach[node], self.start[node]
        away = distances(self.queries[active], self.points[centre][None])[:, 0]
        self._offer(active, np.array([centre]), away[:, None])
        first = away - reach < start - away
        self._visit(low, active[first])
        self._visit(high, active[~first])
        bound = self.factor * self.best[active, -1]
        self._visit(high, active[first & ~(start - away > bound)])
        self._visit(low, active[~first & ~(away - reach > bound)])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in double precision from the differences."""
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, whatever their length."""
    finite = "x is not null and not isnan(x) and abs(x) < double('infinity')"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        f"vec_id is not null and embedding is not null and forall(embedding, x -> {finite}) and exists(embedding, x -> x <> 0)"
    )


def _matrix(cells) -> np.ndarray:
    return np.stack([np.asarray(c, np.float64) for c in cells])


def build(rows: DataFrame, shard_rows: int) -> DataFrame:
    """shard, data: a tree of each shard of about shard_rows rows, staged."""
    shards = max(1, -(-rows.count() // shard_rows))
    points = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("vec_id", kind="stable")
        tree = VantageTree(own["vec_id"].to_numpy(), _matrix(own["embedding"]))
        if (tree.points == tree.points.astype(np.float32)).all():
            tree.points = tree.points.astype(np.float32)  # nothing is lost: they came as such
        return pd.DataFrame({"shard": [key[0]], "data": [tree.dumps()]})

    return stage(points.groupBy("shard").applyInPandas(run, "shard int, data binary"), "neighbour-trees")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 0.5, shard_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: k nearest rows of vectors for each row of queries (both vec_id, embedding), itself apart.

    query_rows: queries that visit a tree together."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "query_id long, vec_id long, score double"
    rows = usable(vectors)
    common = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = common["width"]
    rows, asked = rows.filter(F.size("embedding") == width), usable(queries).filter(F.size("embedding") == width)
    trees = build(rows, shard_rows)
    tasks = min(max(1, -(-common["count"] // shard_rows)), partitions(spark))
    if trees.rdd.getNumPartitions() < tasks:
        trees = trees.repartition(tasks)
    groups = max(1, -(-asked.count() // max(1, GROUP_BYTES // (8 * (width + 1)))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    out = None
    for part in range(groups):  # each a bounded share of the queries
        table = asked.filter(F.col("part") == part).select("vec_id", "embedding").toArrow()
        names, cells = table["vec_id"].to_numpy(), table["embedding"].combine_chunks()
        matrix = cells.flatten().to_numpy().reshape(-1, width)
        shared = spark.sparkContext.broadcast((names, matrix))

        def run(frames, shared=shared):
            names, matrix = shared.value
            best, found = np.full((len(names), k), np.inf), np.full((len(names), k), _NONE)
            for frame in frames:
                for data in frame["data"]:
                    tree = VantageTree.loads(data)
                    for at in range(0, len(names), query_rows):
                        to = at + query_rows
                        best[at:to], found[at:to] = tree.search(matrix[at:to], names[at:to], k, factor, best[at:to], found[at:to])
            ok = np.isfinite(best)
            for at in range(0, len(names), query_rows):
                own = ok[at : at + query_rows]
                yield pd.DataFrame({"query_id": np.repeat(names[at : at + query_rows], own.sum(1)), "vec_id": found[at : at + query_rows][own], "score": best[at : at + query_rows][own]})
            release()

        near = stage(trees.select("data").mapInPandas(run, schema), "neighbours")
        out = near if out is None else out.unionByName(near)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # k rows a task
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
