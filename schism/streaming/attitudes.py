"""Attitudes as a stream: an extension, the batch library has no streams.

Windowed means per pair with a watermark, and exponential averages kept in state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(events: DataFrame, keys: list[str], value: str, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean per key and window; late rows within the watermark still count."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "mean")


def exponential_average(events: DataFrame, key: str, value: str, a: float, order: str = "ts") -> DataFrame:
    """W2 as a stream: the state is the last average of each key; a micro-batch's rows are taken in order."""
    kind = dict(events.dtypes)[key]

    def update(name, frames, state):
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        for x in rows[value]:
            held = x if held is None else a * x + (1 - a) * held
        state.update((float(held),))
        yield pd.DataFrame({key: [name[0]], "ema": [held]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, ema double", "ema double", "update", "NoTimeout")
