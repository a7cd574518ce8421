"""Every query with an SQL equivalent gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from schism.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{SF}/{name}.parquet"):
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    want, got = duck.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_registered_with_defaults(spark, monkeypatch):
    """Clustering queries run as many runs, merges and iterations as their operators do by themselves."""
    from schism.operators import clustering, communities

    given = []
    for module, name in ((communities, "cluster_runs"), (communities, "fellowships"), (clustering, "online_clusters")):
        own = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, own=own, **k: given.append((len(a), set(k))) or own(*a, **k))
    for name in ("g2_g3_fellowships", "a29_comembership", "g12_online_clusters"):
        assert QUERIES[name](spark, SF).columns
    assert len(given) == 4 and all(n == 1 and not k & {"runs", "merge_iter", "iterations"} for n, k in given)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
