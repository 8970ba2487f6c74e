"""Where queries over the driver's tables are registered, each with the SQL that an independent engine runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        ORACLE[name or f.__name__] = sql
        return f

    return register
