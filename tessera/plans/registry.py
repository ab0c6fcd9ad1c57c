"""Where queries register, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, rank: str | None = None) -> Callable[[Query], Query]:
    """rank: a column that is INT in Spark, as its row numbers are."""

    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({rank}::INT AS {rank}) FROM ({sql})" if rank else sql
        return f

    return wrap
