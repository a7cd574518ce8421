"""Rows to Python in bounded pieces: what a function makes of a text takes many times its bytes."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Most bytes and rows of an Arrow batch: both sides hold a batch at a time outside the heap, whole texts in it.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000
#: Most characters (or list entries) that a function works on at once; a longer row is a piece of its own.
PIECE = 1 << 18


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless they already are smaller."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def pieces(column: pa.Array, most: int = PIECE):
    """(start, stop) of runs of rows whose texts (or lists) hold at most `most` bytes (or entries), or of a single row."""
    size = pc.list_value_length(column) if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column)
    ends = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def structs(rows: list[list[tuple]], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as a column of lists of structs; fields that a tuple lacks are null."""
    flat = list(itertools.chain.from_iterable(rows))
    fields = list(kind.value_type)
    columns = list(itertools.zip_longest(*flat)) or [()] * len(fields)
    columns += [(None,) * len(flat)] * (len(fields) - len(columns))
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    own = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends), own)
