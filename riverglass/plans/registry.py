"""Registration of queries: a name, a function of the domain tables, and SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..adapters import Domain, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register the decorated function of a :class:`Domain`; ``sql`` may name domain tables."""

    def add(build: Callable[[Domain], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: build(Domain(spark, folder))
        if sql:
            ORACLES[name] = with_tables(sql)
        return build

    return add
