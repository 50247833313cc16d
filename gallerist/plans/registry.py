"""Registry of named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gallerist.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables)``, where ``tables(name)`` reads one driver table."""

    def keep(f):
        QUERIES[name] = lambda spark, folder: f(lambda t: table(spark, folder, t))
        if sql:
            SQL[name] = sql
        return f

    return keep
