"""Registry of the engine's own queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "hybrid_search_linear"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from loamwork.plans import catalog_graph, catalog_kb, catalog_ops, catalog_service  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
