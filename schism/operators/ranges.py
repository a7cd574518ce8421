"""Running sums over a total order without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import stage


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows before a row (its own left out).

    Rows go to ranges of the order; a window runs inside each range, and the ranges' totals (a row per range, the
    only thing that one task sees whole) are added up before them.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__total"))
    offsets = totals.select("__range", F.coalesce(F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    return ranged.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__offset") + F.coalesce(F.sum(value).over(before("__range")), F.lit(0))).drop("__range", "__offset")
