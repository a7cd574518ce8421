import pytest

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "s0", 5),
    (2, "ALPHA beta\tgamma delta  epsilon zeta", "en", None, None),
    (3, None, None, "s0", 1),
    (4, "", "en", "s1", 0),
    (5, " \n\t", "fr", "s1", 3),
    (6, "été où ça straße 日本語 ½ 🙂", "fr", "s1", 3),
    (7, "x", "en", "s1", 1),
    (7, "x", "en", "s1", 1),
    (8, "12345 678 -- !!", "de", "s1", 9),
    (None, "alpha beta gamma delta epsilon zeta", "en", "s1", 9),
    (9, "it's <|endoftext|> I'LL  don't", "en", "s2", 9),
    (10, " ".join(f"w{i}" for i in range(30_000)), "en", "s2", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeated rows, odd letters, a long text, and extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs.withColumns({c: F.lit(1) for c in ("score", "kept", "n", "node", "shard", "digest", "keep_0", "null_0", "label", "n_tokens", "piece")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
