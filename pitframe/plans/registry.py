"""Where queries register: a name, a function (spark, sf_dir) -> DataFrame, and its DuckDB text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``views`` names the derived views that its SQL reads, set before it as CTEs."""
    from ..fixtures import with_views

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_views(sql, *views.split())
        return f

    return add
