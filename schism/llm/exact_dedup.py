"""Exact dedup (10): stateful streaming deduplication.

Keyed state on disk (a streaming aggregation in RocksDB, without expiry) holds for every digest the stable identifier
to keep, the number of rows and a content locator (run and smallest doc_id, by which the text can be read again).
Rows of a partition are combined before they reach the state, so no hot digest goes there row by row.  A digest
seen more than once is a hit; the full normalised bytes of all hit rows are then compared.  Digests whose bytes
differ (possible only with a shortened digest) are grouped again by their bytes.

With a `state` folder the state outlives the call: checkpoint, digests, updates and the texts at the locators stay
there, and a later run (under a name of its own) is deduplicated against all earlier ones.  Calling again with the
name of a run that failed goes on with it.

Defined cases: null text counts as empty; a null doc_id sorts below all others; of equal texts the largest
doc_id stays; rows that repeat a doc_id and text all carry the same result, and one of them stays in keep_unique;
a doc_id on several texts is dropped only where its text is a copy; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, exists, few, lookup, mark, new_path, partitions, remove, rows_kept, small_batches, spread, stage_small

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DIGESTS = "doc_id long, mark long, digest binary, text_sha256 string"
_UPDATES = "digest binary, keep_id long, locator struct<run: string, doc_id: long>, n long"


def _digests(width: int):
    def run(batches):
        for block in blocks(batches):
            sums = [hashlib.sha256(t.encode("utf-8", "surrogatepass").lower()) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("mark"), pa.array([s.digest()[:width] for s in sums], pa.binary()), pa.array([s.hexdigest() for s in sums])],
                ["doc_id", "mark", "digest", "text_sha256"],
            )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark().alias("mark"))


def _stream(spark: SparkSession, digests: str, updates: str, checkpoint: str, files_per_trigger: int | None) -> DataFrame:
    """Feed the digests that the stream hasn't seen to the state; every digest's latest row of all updates."""
    source = spark.readStream.schema(_DIGESTS + ", run string")
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    place = F.struct("run", "doc_id")
    state = source.parquet(digests).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.min(place).alias("locator"), F.count("*").alias("n"))
    if not exists(spark, updates):
        spark.createDataFrame([], _UPDATES).write.parquet(f"{updates}/epoch=none")

    def sink(batch: DataFrame, epoch: int) -> None:
        few_files = max(8, partitions(spark) // 8)
        batch.coalesce(few_files).write.mode("overwrite").parquet(f"{updates}/epoch={epoch}")  # a repeated epoch replaces itself

    store = "spark.sql.streaming.stateStore."
    names = {store + "providerClass": STATE_STORE, store + "rocksdb.changelogCheckpointing.enabled": "true", store + "rocksdb.boundedMemoryUsage": "true", store + "rocksdb.maxMemoryUsageMB": "64", store + "rocksdb.allowFAllocate": "false", store + "maintenanceInterval": "15s", "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.schema(_UPDATES).parquet(updates, recursiveFileLookup=True)
    return rows.groupBy("digest").agg(F.max_by(F.struct("keep_id", "locator", "n"), "n").alias("s")).select("digest", "s.*")  # the state only grows


def _normalised(batches):
    for block in blocks(batches):
        texts = [t.encode("utf-8", "surrogatepass").lower() for t in block.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("digest"), pa.array(texts, pa.large_binary())], ["doc_id", "digest", "bytes"])


def _placed(docs: DataFrame, digest_bytes: int, files_per_trigger: int | None, state: str | None, run: str) -> DataFrame:
    """Per row of docs: doc_id, mark, keep_id, n, text_sha256."""
    spark = docs.sparkSession
    if state and digest_bytes < 32:
        raise ValueError("a state that is kept takes whole digests")
    rows, root = _texts(docs), state or new_path(spark, "dedup")
    path = f"{root}/digests/run={run}"
    if not exists(spark, f"{path}/_SUCCESS"):
        rows.mapInArrow(_digests(digest_bytes), _DIGESTS).write.mode("overwrite").parquet(path)
    digests = spark.read.schema(_DIGESTS).parquet(path)
    groups = _stream(spark, f"{root}/digests", f"{root}/updates", f"{root}/checkpoint", files_per_trigger)
    if not state:
        remove(spark, f"{root}/checkpoint")
    several = stage_small(groups.filter("n > 1"), "dedup-groups")
    if state:
        several = several.join(digests.select("digest").distinct(), "digest", "left_semi")
    placed = lookup(digests, several.drop("locator"), "digest")  # a digest of a single row keeps that row
    hits = stage_small(placed.filter("n > 1").select("doc_id", "mark", "digest").distinct(), "dedup-hits")
    keys = hits.select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "digest")
    hit_texts = rows.join(F.broadcast(keys) if few(keys) else keys, F.expr("doc_id <=> hit_id and mark = hit_mark")).select("doc_id", "digest", "text")
    if state:
        hit_texts = hit_texts.unionByName(_kept_contents(spark, root, run).join(hits.select("digest").distinct(), "digest", "left_semi").select("doc_id", "digest", "text"))
    contents = hit_texts.mapInArrow(_normalised, "doc_id long, digest binary, bytes binary")
    clash = contents.groupBy("digest").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).filter("a <> b").select("digest")
    clash = stage_small(clash, "dedup-clashes")
    if state:
        if not clash.isEmpty():
            raise ValueError("texts of equal SHA-256 differ")
        _keep_contents(rows, digests, groups, root, run)
    elif not clash.isEmpty():
        return _regroup(digests, groups, contents, clash)
    alone = F.col("n").isNull()
    return placed.withColumns({"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "n": F.when(alone, 1).otherwise(F.col("n")).cast("long")})


def _kept_contents(spark: SparkSession, root: str, run: str) -> DataFrame:
    """Texts at the locators of earlier runs."""
    schema = "doc_id long, digest binary, text string, run string"
    found = spark.read.schema(schema).parquet(f"{root}/contents") if exists(spark, f"{root}/contents") else spark.createDataFrame([], schema)
    return found.filter(F.col("run") != run)


def _keep_contents(rows: DataFrame, digests: DataFrame, groups: DataFrame, root: str, run: str) -> None:
    """Write the texts at the locators that lie in this run, one for each digest that it brought."""
    own = groups.filter(F.col("locator.run") == run).select("digest", F.col("locator.doc_id").alias("at"))
    first = digests.join(own, "digest").filter("doc_id <=> at").groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    first = stage_small(first.select("digest", F.col("first.doc_id").alias("at"), F.col("first.mark").alias("at_mark")), "dedup-locators")
    found = rows.join(first, F.expr("doc_id <=> at and mark = at_mark")).select("doc_id", "digest", "text")
    found.write.mode("overwrite").parquet(f"{root}/contents/run={run}")


def _regroup(digests: DataFrame, groups: DataFrame, contents: DataFrame, clash: DataFrame) -> DataFrame:
    """Digests with different bytes behind them: group those rows by their bytes; the others as the state has them."""
    plain = digests.join(groups.join(clash, "digest", "left_anti"), "digest")
    rows = contents.join(clash, "digest", "left_semi").distinct()
    sized = digests.join(clash, "digest", "left_semi").groupBy("doc_id", "digest", "text_sha256").agg(F.count("*").alias("rows"))
    by_bytes = rows.withColumn("text_sha256", F.sha2("bytes", 256)).join(sized.withColumnRenamed("doc_id", "id"), ["digest", "text_sha256"]).filter("doc_id <=> id")
    found = by_bytes.groupBy("bytes").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("n"))
    fixed = by_bytes.join(found, "bytes").select("id", F.col("text_sha256").alias("sum"), "keep_id", "n")
    again = digests.join(clash, "digest", "left_semi").join(fixed, F.expr("doc_id <=> id and text_sha256 = sum"))
    cols = ["doc_id", "mark", "keep_id", "n", "text_sha256"]
    return plain.select(cols).unionByName(again.select(cols))


def dedup(docs: DataFrame, digest_bytes: int = 32, files_per_trigger: int | None = None, state: str | None = None, run: str = "only") -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    digest_bytes shortens the key of the state (tests force collisions with it); the result stays the same.  With a
    state folder, keep_id and group_size are over this and all earlier runs.
    """
    placed = _placed(docs, digest_bytes, files_per_trigger, state, run)
    return placed.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def keep_unique(docs: DataFrame, digest_bytes: int = 32, files_per_trigger: int | None = None, state: str | None = None, run: str = "only") -> DataFrame:
    """Rows of docs with the columns of docs, one of each text: that with the largest doc_id."""
    placed = _placed(docs, digest_bytes, files_per_trigger, state, run).filter("n > 1")
    own = placed.groupBy("doc_id", "text_sha256", "mark").agg(F.max(F.expr("doc_id <=> keep_id")).alias("kept"), F.count("*").alias("rows"))
    least = F.min("mark").over(Window.partitionBy("doc_id", "text_sha256"))  # texts of one id that differ in case
    decided = own.withColumn("least", least).select("doc_id", "mark", F.expr("kept and mark = least").alias("stays"), "rows")
    return rows_kept(docs, stage_small(decided.filter("not stays or rows > 1"), "dedup-decided"))
