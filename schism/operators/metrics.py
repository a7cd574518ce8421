"""Classification metrics and retrieval of trained vectors (ids L2, L5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def binary_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1; 0 where undefined."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    count = lambda c: F.sum(c.cast("int"))
    s = rows.agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"), count(~t & ~p).alias("tn"))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    d = lambda a, b: z(F.try_divide(a.cast("double"), b.cast("double")))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return s.select("tp", "fp", "fn", "tn", d(tp + tn, tp + fp + fn + tn).alias("accuracy"), d(tp, tp + fp).alias("precision"), d(tp, tp + fn).alias("recall"), d(2 * tp, 2 * tp + fp + fn).alias("f1"))


def auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve from counts per distinct score, ties half."""
    from .ranges import running_sum

    per = rows.groupBy(score).agg(F.sum((F.col(truth) == 1).cast("int")).alias("p"), F.sum((F.col(truth) != 1).cast("int")).alias("n"))
    return running_sum(per, [score], "n", "below").agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def lookup(names: DataFrame, vectors: DataFrame, key: str = "name") -> DataFrame:
    """L2: vectors by name; unknown names have none."""
    return names.join(vectors, key, "left")


def embedding_matrix(words: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Word, row (0.. by name), vector of every different word; zeros for a word without one (vectors: word, vector)."""
    from .ranges import running_sum

    numbered = running_sum(words.select("word").distinct().withColumn("one", F.lit(1)), ["word"], "one", "row")
    zero = F.array_repeat(F.lit(0.0), size)
    return numbered.join(vectors, "word", "left").select("word", F.col("row").cast("int").alias("row"), F.coalesce("vector", zero).alias("vector"))
