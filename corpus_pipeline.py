"""The corpus pipeline: documents that pass the filters, without copies, packed into sequences.

Null and empty texts have no language and go with the language stage, if the quality stage keeps them; of rows that
repeat id and text one reaches the last stage, of texts that are copies or linked one each, as the dedup stages say,
whatever ids are null or repeated; extra columns are passed on as they are; an empty table gives no sequences.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from schism.llm import exact_dedup, jaccard_join, language, packing, quality
from schism.llm.common import release_heaps, small_reads, stage
from schism.llm.queries import tokenizer


def lean(function):
    """A stage that starts in small heaps, and so does its last pass: all stages run in the same executors, which else stay as large as the largest step has made them."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_reads(spark)
        release_heaps(spark)
        out = function(spark, docs, sf_dir)
        release_heaps(spark)
        return out

    return run


@lean
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality classifier, fitted on the labels, scores at 0.3 or more; a null text is scored as an empty one."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@lean
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with calibrated confidence; texts that are null or without a letter go."""
    return language.keep(docs, language.fit(docs))


@lean
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest doc_id (null below all others); of rows that repeat both, one."""
    return exact_dedup.keep_unique(docs)


@lean
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, the one with the smallest doc_id (null after all others); texts without words stay."""
    return jaccard_join.keep_one(docs, n=5, threshold=(80, 100))


@lean
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of permitted lengths in tokens: a row for each piece of a document."""
    return packing.pack_documents(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality", quality_stage), ("language", language_stage), ("exact dedup", exact_dedup_stage), ("near dedup", near_dedup_stage), ("packing", packing_stage)]

#: Classifiers trained by gradient descent have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
