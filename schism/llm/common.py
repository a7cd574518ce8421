"""Shared pieces of the training-data operators: staging, block tokenising, word hashes, packed payloads."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import PIECE, small_batches  # noqa: F401 (for the operators)

#: Bytes of text that a Python worker turns into arrays at a time; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Rows below which a list of keys may be broadcast (8 to 16 bytes each); larger lists are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: Most rows of a batch that is read from a stage of blocks.
READ_ROWS = 64

#: Longest word, in bytes, that is hashed eight bytes at a time; longer ones are hashed as a whole by BLAKE2b.
CHUNKED = 64
_HASH_KEY = b"schism word hash"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset, a new local one in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="schism-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


#: A local shared folder is written without checksum files: for each file's permission Hadoop starts a process, in which the whole executor's memory shows once more until it begins.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, so a lost executor costs at most one stage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**_PLAIN, **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def stage_small(df: DataFrame, name: str, heavy: bool = False) -> DataFrame:
    """As stage, for tables of ids and links: an eighth of the shuffle's partitions, so fewer and larger files.

    heavy: what makes the rows is work for all tasks, so they are shuffled to the fewer ones only then."""
    files = max(8, partitions(df.sparkSession) // 8)
    return stage(df.repartition(files) if heavy else df.coalesce(files), name)


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    remove(df.sparkSession, df._staged_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size: that of its files where it is read from files.  Only ever steers how work is divided."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most this many rows, so that it may be broadcast."""
    return df.limit(most + 1).count() <= most


def mark(column: str = "text"):
    """A column that tells rows of one doc_id with different texts apart."""
    return F.xxhash64(column)


def rows_kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of docs with all columns of docs, as a staged table of (doc_id, mark, stays, rows) decides; the others stay.

    Of rows that stay and repeat both doc_id and text (rows > 1) one is kept.  A null doc_id is like any other."""
    name = next(n for n in (f"mark_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    marked = docs.withColumn(name, mark())

    def matched(rows: DataFrame, which: str, how: str) -> DataFrame:
        keys = decided.filter(which).select(F.col("doc_id").alias("decided_id"), F.col("mark").alias("decided_mark"))
        keys = F.broadcast(keys) if few(keys) else keys.hint("merge")
        return rows.join(keys, rows["doc_id"].cast("long").eqNullSafe(keys["decided_id"]) & (rows[name] == keys["decided_mark"]), how)

    out = matched(marked, "not stays", "left_anti")
    if not decided.filter("stays and rows > 1").isEmpty():
        once = matched(out, "stays and rows > 1", "left_semi").dropDuplicates(["doc_id", name])
        out = matched(out, "stays and rows > 1", "left_anti").unionByName(once)
    return out.select(*(out[f"`{c}`"] for c in docs.columns))


#: Parts into which the rows of a hot key are split in a lookup too large to broadcast.
SALTS = 32


def lookup(left: DataFrame, right: DataFrame, on: str, row: str = "doc_id") -> DataFrame:
    """Left join with a staged table whose keys are unique, without gathering a hot key's rows in one task.

    Few keys (counted) are broadcast, so left isn't shuffled at all; else left's rows are split by a hash of `row`
    and right is repeated for each part."""
    if few(right):
        return left.join(F.broadcast(right), on, "left")
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")).join(salted, [on, "__salt"], "left").drop("__salt")


def small_reads(spark: SparkSession) -> None:
    """Bound the rows that Parquet's reader turns into columns at once, unless fewer already: where a row is a block of megabytes, it holds all of them in one array that grows by doubling."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))


def release_heaps(spark: SparkSession) -> None:
    """Have every executor collect its garbage: a heap that one step has grown else keeps that size, beside the workers of the next.

    A task for each idle executor, which the scheduler deals out one by one; an executor that gets none merely stays as it is."""
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is counted too
    spark.range(0, executors, 1, executors).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores, if what they are read from gives less than half as many tasks (a small table in one file)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if 2 * docs.rdd.getNumPartitions() <= cores else docs


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, to go to Python in small batches."""
    small_batches(docs.sparkSession)
    return spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def release() -> None:
    """Give freed memory back: a worker outlives its stage, and what its allocators hold counts beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(function):
    """A function of pandas groups that gives freed memory back behind each."""

    def run(frame):
        out = function(frame)
        release()
        return out

    return run


def blocks(batches, column: str = "text", most: int = BLOCK_BYTES):
    """Slices of Arrow batches whose texts hold at most `most` bytes, or a single row; null texts become empty."""
    try:
        yield from _blocks(batches, column, most)
    finally:
        release()


def _blocks(batches, column: str, most: int):
    for batch in batches:
        at = batch.schema.get_field_index(column)
        col = batch.column(at)
        if col.null_count:
            col = col.fill_null("")
        col = col.cast(pa.large_string())
        batch = batch.set_column(at, column, col)
        if not batch.num_rows:
            continue
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets of each text in them)."""
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (finaliser of a well-known hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: start and end bytes, and for each text its first word's number."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    begins = inside[1:] & ~inside[:-1]
    edge = offsets[1:-1]
    cut = edge[(edge > 0) & (edge < len(raw))]
    begins[cut] |= inside[cut + 1]
    starts = np.flatnonzero(begins[:-1])
    closing = inside[1:-1] & ~inside[2:]
    closing[cut - 1] |= inside[cut]
    ends = np.flatnonzero(closing) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LEADING = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as an integer (zeros behind the end), a view of a padded copy."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


def leading(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first `left` bytes, eight at most, at each place of a view by `eights`."""
    return view[at] & _LEADING[np.clip(left, 0, 8)]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: its bytes are mixed in by eights, so no regularity of a text makes words collide."""
    size = ends - starts
    found = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(size):
        return found
    view, which = eights(raw), np.arange(len(size))
    for at in range(0, min(int(size.max()), CHUNKED), 8):
        if at:
            which = which[size[which] > at]
        left = size[which] - at
        found[which] = mix(found[which] ^ leading(view, starts[which] + at, left))
    for i in np.flatnonzero(size > CHUNKED):
        found[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=_HASH_KEY).digest(), "little")
    return found


def same_bytes(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether `size` bytes from a in one array are those from b in the other, for each of a and b."""
    found, which = np.ones(len(size), bool), np.arange(len(size))
    x, y = eights(one), eights(other)
    for at in range(0, min(int(size.max()), CHUNKED) if len(size) else 0, 8):
        if at:
            which = which[size[which] > at]
        left = size[which] - at
        found[which] &= leading(x, a[which] + at, left) == leading(y, b[which] + at, left)
    for i in np.flatnonzero(size > CHUNKED):
        found[i] = bool((one[a[i] : a[i] + size[i]] == other[b[i] : b[i] + size[i]]).all())
    return found


def lower_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the texts with A-Z in lower case, first word's number for each text and the end)."""
    raw, offsets = text_bytes(col)
    raw = _LOWER[raw]
    starts, ends, first = spans(raw, offsets)
    return word_hashes(raw, starts, ends), first


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, its bytes stored plane by plane."""
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T.tobytes()
    return len(values).to_bytes(8, "little") + values.dtype.str.encode().ljust(4) + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, kind = int.from_bytes(data[:8], "little"), np.dtype(data[8:12].decode().strip())
    planes = pa.decompress(data[12:], n * kind.itemsize, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the smallest unsigned type."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def crc_mod(ids, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo; a null id counts as empty text."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids), np.int64, len(ids))
