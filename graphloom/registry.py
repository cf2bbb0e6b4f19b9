"""All queries of the graph engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL for its rows if SQL can express it."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries named {name}")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    import graphloom.plans.catalog  # noqa: F401

    return _queries


def oracle_sql() -> dict[str, str]:
    import graphloom.plans.catalog  # noqa: F401

    return _sql
