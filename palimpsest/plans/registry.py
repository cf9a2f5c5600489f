"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.domain import History, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(views: str = "", sql: str | None = None, recursive: bool = False):
    """Register a function of History under its name."""

    def add(f: Callable[[History], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(History(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(views, sql.strip(), recursive) if views else sql
        return f

    return add
