"""All registered telemetry queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import batching_queries, capacity_queries, detection_queries, experiment_queries, join_queries, multiobjective_queries, profile_queries, rollup_queries, scalar_queries, source_queries, streaming_queries, trajectory_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
