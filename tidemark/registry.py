"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Make a query known under a name; ``sql`` is the same query for DuckDB, where SQL can say it."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return add


from tidemark.plans import queries_ingest, queries_models, queries_relational, queries_series, queries_statistics, queries_sync  # noqa: E402, F401
