"""Row numbers of ordered groups that no single task holds.

A window numbers each key's rows in one task. With few keys and many rows that is the whole job, so here rows are range-partitioned on (keys, order):
each task numbers its own stretch, and the counts of the stretches, a row for each task and key, give every stretch its offset.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], out: str, total: str | None = None) -> DataFrame:
    """Adds ``out``, the rows' numbers from 1 per key in ``order``, and ``total``, the key's number of rows; null keys are a group. Ties get some order."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"o{i}_" for i in range(len(by))]
    placed = df.withColumns(dict(zip(names, by, strict=True))).repartitionByRange(*keys, *names).withColumn("part_", F.spark_partition_id())
    placed = stored(placed, "ranks")  # the stretches must stay as they are
    counts = placed.groupBy(*keys, "part_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("part_").alias("p_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"), F.sum("n_").over(Window.partitionBy(*keys)).alias("all_"))
    within = F.row_number().over(Window.partitionBy(*keys, "part_").orderBy(*names))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys], F.col("part_") == F.col("p_"))
    found = placed.withColumn("at_", within).join(offsets, same).withColumn(out, (F.col("at_") + F.col("before_")).cast("long"))
    return found.select(*df.columns, out, *([F.col("all_").alias(total)] if total else []))
