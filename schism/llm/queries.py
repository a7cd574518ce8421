"""The queries of the training-data operators: each over its whole table, with the columns that their users agreed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard_join, language, language_model, neighbours, packing, quality, token_counts, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _held(modulus: int, remainder: int):
    """Whether crc32 of doc_id as text leaves this remainder (a null id counts as empty text)."""
    return (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder).alias("held_out")


def op1_language_model(spark, sf_dir):
    return language_model.score(_table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_token_ids(spark, sf_dir):
    return token_files.encode_and_check(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard_join.join_components(_table(spark, sf_dir, "documents"), n=4, threshold=(85, 100))


def op5_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op6_token_counts(spark, sf_dir):
    return token_counts.counts(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), cover=True)


def op7_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", _held(4, 2), "lang_pred", "score", "rejected")


def op9_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_model, op2_packing, op3_token_ids, op4_ngram_jaccard, op5_neighbours, op6_token_counts, op7_quality, op8_language, op9_bpe, op10_exact_dedup)}

ORACLES = {
    "op4_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.m FROM reach r JOIN edges e ON e.x = r.doc_id)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(m) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)""",
}
