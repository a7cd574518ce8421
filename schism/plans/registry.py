"""The registered queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n) if not isinstance(c, str) else F.round(F.col(c), n).alias(c)
