"""Collects the registered queries and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; `sql` are CTEs with the final SELECT."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = "WITH " + sql.strip()
        return fn

    return add
