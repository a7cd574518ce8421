"""Stage tables: one Parquet table per step of an analysis, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new local folder where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="schism-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write and read again; without a path, in a fresh folder that goes with the application."""
    spark = df.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, most: int = 4 << 20) -> int:
    """Into how many parts to deal df so that one holds a bounded share of its input: one for each `most` bytes read, as many as there are shuffle partitions at least."""
    read = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-read // most)) if read < 1 << 50 else least  # a size that Spark doesn't know


def small(rows: DataFrame, few: DataFrame, *on: str, most: int = 100_000) -> DataFrame:
    """rows joined with a list, broadcast after a count, else by a shuffle: a size that Spark can't tell beforehand would have the rows shuffled."""
    return rows.join(F.broadcast(few) if few.limit(most + 1).count() <= most else few, list(on))


def new_rows(df: DataFrame, done: DataFrame, key: str = "uid") -> DataFrame:
    """Incremental stages: rows whose key isn't in the stage table yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")
