"""The table of queries and of their SQL, and SQL fragments that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW, T1, AS_OF, T2 = (f"TIMESTAMP '{t}'" for t in (X.NOW, X.T1, X.AS_OF, X.T2))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def valid(t: str, p: str = "") -> str:
    return f"({p}valid_at <= {t} AND ({p}invalid_at IS NULL OR {t} < {p}invalid_at))"


def age(t: str) -> str:
    """Whole days from t to NOW."""
    return f"greatest(0, CAST(floor((epoch_us({NOW}) - epoch_us({t})) / 86400000000.0) AS BIGINT))"
