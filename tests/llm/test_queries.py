"""The registered queries: columns, rows and folds as agreed, on the smallest tables."""

import zlib

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op2_packing": ["doc_id", "piece"],
    "op3_token_ids": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op5_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op6_token_counts": ["doc_id", "n_words", "n_tokens", "n_unknown"],
    "op7_quality": ["doc_id", "held_out", "score", "predicted"],
    "op8_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}
FOLDS = {"op1_language_model": (7, 2), "op7_quality": (5, 0), "op8_language": (4, 2)}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    out = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert list(out.columns)[: len(COLUMNS[name])] == COLUMNS[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name == "op5_neighbours":
        vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
        assert len(out) == 10 * vectors.filter("vec_id % 100 = 0").count() and (out["query_id"] != out["vec_id"]).all()
    elif name == "op2_packing":
        assert out["doc_id"].nunique() == docs
    else:
        assert len(out) == docs and out["doc_id"].is_unique
    if name in FOLDS:
        modulus, rest = FOLDS[name]
        assert out["held_out"].tolist() == [zlib.crc32(str(i).encode()) % modulus == rest for i in out["doc_id"]]
    if name == "op1_language_model":
        held = out[out["held_out"]]
        assert (held["score"].sum() / held["n_tokens"].sum()) > (held["base_score"].sum() / held["n_tokens"].sum())


@pytest.mark.parametrize("name", ["op4_ngram_jaccard", "op10_exact_dedup"])
def test_oracle(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = duck.execute(__spark_entry__.oracle_sql()[name]).df(), __spark_entry__.queries()[name](spark, SF).toPandas()
    order = sorted(want.columns)
    assert want[order].sort_values("doc_id").astype(str).values.tolist() == got[order].sort_values("doc_id").astype(str).values.tolist()


def test_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(__spark_entry__.queries())
