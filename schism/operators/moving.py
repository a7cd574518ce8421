"""Moving averages over ordered series (ids W1-W5).

A series may hold any share of the rows: rows go to ranges of (keys, order), so a long one lies in several tasks, and
what it brings from one range to the next is a row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import stage

#: Rows of a series that one window takes at once.
BLOCK = 1 << 16


def _ranges(df: DataFrame, keys, order) -> DataFrame:
    return df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())


def _carried(parts: DataFrame, carries: DataFrame, keys) -> DataFrame:
    """parts with what their series brings along from earlier ranges; only a range's first series does, so carries have at most a row per range."""
    names = [c for c in carries.columns if c not in (*keys, "__range")]
    given = carries.select(F.col("__range").alias("__at"), *(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), *names)
    same = F.col("__range") == F.col("__at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__{i}"))
    return parts.join(F.broadcast(given), same, "left").drop("__at", *(f"__{i}" for i in range(len(keys))))


def _running(df: DataFrame, keys, order, **values) -> DataFrame:
    """Adds per name the sum of an expression over the rows of the series up to each row."""
    parts = stage(_ranges(df.withColumns(values), keys, order), "series")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__range", *keys).agg(*(F.sum(c).alias(c) for c in values), F.lit(1).alias("__one"))
    earlier = totals.select("__range", *keys, *(F.sum(c).over(before).alias(f"__before_{c}") for c in values), F.sum("__one").over(before).alias("__seen"))
    within = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumns({c: F.sum(c).over(within) for c in values})
    both = _carried(own, earlier.filter("__seen > 0").drop("__seen"), keys)
    total = lambda c: F.when(F.col(f"__before_{c}").isNull(), F.col(c)).otherwise(F.coalesce(F.col(c), F.lit(0)) + F.col(f"__before_{c}"))
    return both.withColumns({c: total(c) for c in values}).drop("__range", *(f"__before_{c}" for c in values))


def _trailing(df: DataFrame, keys, order, n: int):
    """Rows with __i (place in the series from 1) in blocks of a series, each with the n - 1 rows before it (__own false), and the trailing window of n rows."""
    size = max(BLOCK, n)
    placed = _running(df, keys, order, __i=F.lit(1).cast("long"))
    block = F.floor((F.col("__i") - 1) / size)
    late = (F.col("__i") - 1) % size >= size - (n - 1)
    rows = placed.withColumn("__home", block).withColumn("__block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    return rows.withColumn("__own", F.col("__block") == F.col("__home")), Window.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(-(n - 1), 0)


def _own(rows: DataFrame) -> DataFrame:
    return rows.filter("__own").drop("__i", "__home", "__block", "__own")


def simple(df: DataFrame, keys, order, value: str, n: int, empty=None, partial: bool = True) -> DataFrame:
    """Trailing mean of n rows; before that the mean of those there are, or `empty`."""
    rows, w = _trailing(df, keys, order, n)
    mean = F.avg(value).over(w)
    return _own(rows.withColumn("sma", mean if partial else F.when(F.col("__i") < n, F.lit(empty).cast("double")).otherwise(mean)))


def cumulative(df: DataFrame, keys, order, value: str) -> DataFrame:
    """Running mean."""
    rows = _running(df, keys, order, __sum=F.col(value), __n=F.col(value).isNotNull().cast("long"))
    return rows.withColumn("cma", F.try_divide(F.col("__sum").cast("double"), F.col("__n").cast("double"))).drop("__sum", "__n")


def weighted(df: DataFrame, keys, order, value: str, n: int) -> DataFrame:
    """Trailing mean of n rows with weights 1..k, oldest to newest."""
    rows, w = _trailing(df, keys, order, n)
    held = F.collect_list(value).over(w)
    total = F.aggregate(F.zip_with(held, F.sequence(F.lit(1), F.size(held)), lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
    return _own(rows.withColumn("wma", total / (F.size(held) * (F.size(held) + 1) / 2)))


def exponential(df: DataFrame, keys, order, value: str, a: float) -> DataFrame:
    """A x + (1 - a) previous, seeded by the first value.

    Each range of sorted rows is folded in Arrow batches as if its series began there; k rows on, a start that was off
    by s is off by (1 - a)^k s, which is added for the series that came from an earlier range.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    kinds, back = dict(df.dtypes), 1 - a
    rows = _ranges(df, keys, order).sortWithinPartitions(*keys, *order)

    def run(batches):
        last, held, count = None, 0.0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                starts[1:] |= code[1:] != code[:-1]
            name = lambda i: tuple(batch.column(k)[i].as_py() for k in keys)  # noqa: B023, E731
            starts[0] = name(0) != last
            x = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
            ema, share = np.where(starts, x, a * x), np.where(starts, 0.0, back)
            ema[0] += share[0] * held
            step = 1
            while step < n and share[step:].any():  # each row knows 2, 4, 8 rows back
                ema[step:] += share[step:] * np.where(share[step:] != 0, ema[:-step], 0)
                share[step:] *= share[:-step].copy()
                step *= 2
            at = np.arange(n)
            begun = np.maximum.accumulate(np.where(starts, at, -1))
            place = np.where(begun < 0, at + 1 + count, at - begun + 1)
            last, held, count = name(n - 1), ema[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ema), pa.array(place, pa.int64())], [*batch.schema.names, "ema", "__k"])

    parts = stage(rows.mapInArrow(run, f"{rows.drop('ema').schema.simpleString()[7:-1]}, ema:double, __k:bigint"), "series")
    ends = parts.groupBy("__range", *keys).agg(F.min_by("ema", "__k").alias("__first"), F.max_by("ema", "__k").alias("__last"), F.max("__k").alias("__n"))
    several = ends.withColumn("__several", F.count("*").over(Window.partitionBy(*keys))).filter("__several > 1").drop("__several")

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__range", ignore_index=True)
        off, end = [], None
        for first, ended, n in zip(frame["__first"], frame["__last"], frame["__n"]):
            off.append(0.0 if end is None else end - first)
            end = ended + back**n * off[-1]
        return frame.assign(__off=off)[["__range", *keys, "__off"]].iloc[1:]

    carries = several.groupBy(*keys).applyInPandas(carry, ", ".join(["__range int", *(f"{k} {kinds[k]}" for k in keys), "__off double"]))  # a row per range
    ema = F.col("ema") + F.coalesce(F.pow(F.lit(back), F.col("__k")) * F.col("__off"), F.lit(0.0))
    return _carried(parts, carries, keys).withColumn("ema", ema).drop("__range", "__k", "__off")


def days(n: int) -> float:
    """Smoothing factor of an n-day average."""
    return 2 / (n + 1)
