"""Joins on time, position and class, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered


def with_fallback(recent: DataFrame, profiled: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every key of either side; values of ``recent`` where it has them, else of ``profiled``."""
    a, b = recent.select(*keys, *values), profiled.select(*keys, *[F.col(v).alias(f"{v}_p") for v in values])
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(v, f"{v}_p").alias(v) for v in values])


def fill_missing(recent: DataFrame, profiled: DataFrame, key: str, least: int = 3) -> DataFrame:
    """``recent`` groups of at least ``least`` rows (column n), and ``profiled`` rows whose key is not among them."""
    seen = recent.where(F.col("n") >= least)
    return seen.unionByName(profiled.join(seen.select(key), key, "left_anti"), allowMissingColumns=True)


def route(detections: DataFrame, edges: DataFrame) -> DataFrame:
    """Detections to every downstream edge of their class, and to edges of class -1, which take null classes too.

    The edges are a graph's few rows: they are broadcast, so that a class with most of the detections stays spread over all tasks.
    """
    on_class = detections.join(F.broadcast(edges.where("coi <> -1")), F.col("class_id") == F.col("coi"))
    return on_class.unionByName(detections.crossJoin(F.broadcast(edges.where("coi = -1"))))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, width: int, backward: bool = True) -> DataFrame:
    """Adds ``value`` of the last ``right`` row with time at or before ``at`` (or the first at or after it), null where there is none; and its time, as ``at_``.

    Time is cut into buckets of ``width``. What a bucket inherits comes from a window over one row per bucket; inside a
    bucket one sorted pass finds the last row, so a key with a third of all rows is spread over its buckets.
    """
    sign = F.lit(1 if backward else -1)
    bucket = F.floor(F.col(at) * sign / width).alias("b_")
    r = right.select(*keys, bucket, (F.col(at) * sign).alias("o_"), F.struct(F.col(at).alias("at_"), F.col(value).alias(value)).alias("hit_"), F.lit(0).alias("side_"))
    names = left.columns
    l_ = left.select(*keys, bucket, (F.col(at) * sign).alias("o_"), F.struct(*names).alias("row_"), F.lit(1).alias("side_"))
    last = r.groupBy(*keys, "b_").agg(F.max_by("hit_", "o_").alias("end_"))
    spots = l_.select(*keys, "b_").unionByName(r.select(*keys, "b_")).distinct().join(last, [*keys, "b_"], "left")
    before = Window.partitionBy(*keys).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select(*keys, "b_", F.last("end_", ignorenulls=True).over(before).alias("carry_"))
    both = l_.unionByName(r, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "b_").orderBy("o_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("in_", F.last("hit_", ignorenulls=True).over(upto)).where("side_ = 1").join(carried, [*keys, "b_"], "left")
    hit = F.coalesce("in_", "carry_")
    return found.select("row_.*", hit[value].alias(value), hit["at_"].alias("at_"))


def step_value(left: DataFrame, steps: DataFrame, keys: list[str], at: str, value: str, width: int) -> DataFrame:
    """``as_of`` backward; before a trace's first step, that step's value."""
    first = steps.groupBy(*keys).agg(F.min_by(value, at).alias("first_"))
    found = as_of(left, steps, keys, at, value, width).drop("at_")
    return found.join(first, keys, "left").withColumn(value, F.coalesce(value, "first_")).drop("first_")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, width: int) -> DataFrame:
    """Adds ``value`` of the right row nearest in time; the earlier of two equally near."""
    names = left.columns
    back = as_of(left, right, keys, at, value, width).withColumnsRenamed({value: "v0_", "at_": "a0_"})
    both = as_of(back, right, keys, at, value, width, backward=False).withColumnsRenamed({value: "v1_", "at_": "a1_"})
    earlier = F.col("a1_").isNull() | (F.col(at) - F.col("a0_") <= F.col("a1_") - F.col(at))
    return both.select(*names, F.when(F.col("a0_").isNotNull() & earlier, F.col("v0_")).otherwise(F.col("v1_")).alias(value))


def positional_difference(series: DataFrame, base: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Difference of two series by position per key, up to the end of the shorter."""
    number = lambda df, name: numbered(df.select(*dict.fromkeys([*keys, *order, value])), keys, order, "i").select(*keys, "i", F.col(value).alias(name))
    return number(series, "a_").join(number(base, "b_"), [*keys, "i"]).select(*keys, "i", (F.col("a_") - F.col("b_")).alias("difference"))


def mean_by_position(series: DataFrame, key: str, order: list[str], value: str, of_all: bool) -> DataFrame:
    """Mean over series at every position; divided by all series, or by those long enough."""
    rows = numbered(series.select(*dict.fromkeys([key, *order, value])), [key], order, "i")
    n = rows.select(key).distinct().count() if of_all else None
    mean = F.sum(value) / F.lit(n) if of_all else F.round(F.avg(value), 2)
    return rows.groupBy("i").agg(mean.alias("mean"))


def device_pairs(up: DataFrame, here: DataFrame) -> DataFrame:
    """Pairs of an upstream device and one of this model's, per pipeline; a server does not send back to another device."""
    return up.join(here, "pipeline").where(~((F.col("sender") == "server") & (F.col("receiver") != "server")))


def full_grid(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Every cell of the mesh of two parameters' values; 0 where there is no run. The mesh is the size of the result."""
    mesh = df.select(x).distinct().crossJoin(df.select(y).distinct())
    return mesh.join(df.groupBy(x, y).agg(F.sum(value).alias(value)), [x, y], "left").fillna(0, [value])


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")
