"""Connected components of a link table, as a loop of DataFrame steps; nothing of it reaches the driver but counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage_small

_FLUSH = 200_000


class _Forest:
    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches):
    """Links of a partition as links of each node with its smallest known relative: fewer and shorter paths."""
    forest = _Forest()

    def out():
        nodes = [x for x in forest.up if forest.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([forest.root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.join(a, b)
        if len(forest.up) > _FLUSH:
            yield out()
            forest = _Forest()
    if forest.up:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of links (a, b: long, not null)."""
    edges = links.select("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long").distinct()
    both = stage_small(edges.union(edges.select("b", "a")), "links")
    labels = stage_small(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("far"))  # the label's own label
        after = stage_small(step.join(jump, "to").select("node", F.least("to", "far").alias("root"), (F.least("to", "far") < F.col("root")).alias("changed")), "labels")
        more = not after.filter("changed").isEmpty()
        drop_stage(labels)
        path, labels = after._staged_path, after.select("node", "root")
        labels._staged_path = path
        if not more:
            drop_stage(both)
            return labels
