"""Profile queries over fact tables: recent data first, profiled data where there is none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import PERIODS
from ..functions.quantiles import nearest_rank
from ..functions.scalars import default_package_size
from .joins import as_of, with_fallback
from .ranks import numbered


def greatest_of(prefix: str, agg, periods: tuple[int, ...] = PERIODS) -> Column:
    return F.greatest(*[agg(f"{prefix}_{p}s") for p in periods])


def arrival_rate_cv(recent: DataFrame, profiled: DataFrame, keys: list[str]) -> DataFrame:
    """Largest summed rate and largest mean variation over the periods; without recent rows, the mean of the profiled rows' largest; else 0."""
    now = recent.groupBy(*keys).agg(greatest_of("arrival_rate", F.sum).alias("rate"), greatest_of("coeff_var", F.avg).alias("cv"))
    then = profiled.groupBy(*keys).agg(F.avg(greatest_of("arrival_rate", F.col)).alias("rate"), F.avg(greatest_of("coeff_var", F.col)).alias("cv"))
    return with_fallback(now, then, keys, ["rate", "cv"]).fillna(0.0, ["rate", "cv"])


NETWORK = ("p95_out_queueing_duration_us", "p95_transfer_duration_us", "p95_queueing_duration_us", "p95_total_package_size_b")


def newest(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The newest ``rows`` rows per key; each task passes on no more than these."""
    w = Window.partitionBy(*keys).orderBy(F.desc("timestamps"), F.desc("event_id"))
    return df.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= rows).drop("rn_")


SHORT = dict(zip(("out_queue", "transfer", "queue", "size"), NETWORK, strict=True))


def _largest(df: DataFrame, keys: list[str], rows: int, agg: Callable[[str], Column], prefix: str, names: tuple[str, ...] = tuple(SHORT)) -> DataFrame:
    return newest(df, keys, rows).groupBy(*keys).agg(*[agg(SHORT[n]).alias(f"{prefix}_{n}") for n in names], F.lit(True).alias(f"has_{prefix}"))


def _transfers(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds latency, that of size ``p_size`` by the entries of each link; null where a link or size has none."""
    return estimate_latency(links, entries, "p_size", keys=["sender", "receiver"])


def network_profile(links: DataFrame, recent: DataFrame, profiled: DataFrame, entries: DataFrame, rows: int = 100) -> DataFrame:
    """Adds out_queue, transfer, queue and size to ``links`` (stream, sender, receiver, receiver_type, task, model).

    The largest of a link's newest ``rows`` recent rows; without any, those profiled for the receiver's type and the model, where a detector's package has its model's default size
    and the transfer is what the link's entries say of that size, or 0 for a detector that gets its frames on the same device other than the server.
    """
    now = _largest(recent, ["stream", "sender", "receiver"], rows, F.max, "r")
    then = _largest(profiled, ["receiver_type", "model"], rows, F.max, "p", ("out_queue", "queue", "size"))
    out = links.join(now, ["stream", "sender", "receiver"], "left").join(then, ["receiver_type", "model"], "left")
    detector = F.col("task").contains("yolo")
    out = out.withColumn("p_size", F.when(detector & F.col("has_p"), default_package_size(F.col("model"))).otherwise(F.col("p_size")))
    out = _transfers(out, entries)
    local = detector & (F.col("sender") != "server") & (F.col("sender") == F.col("receiver"))
    profile = {"out_queue": F.col("p_out_queue"), "transfer": F.when(local & F.col("has_p"), F.lit(0)).otherwise(F.col("latency")), "queue": F.col("p_queue"), "size": F.col("p_size")}
    return out.select(*links.columns, *[F.when(F.col("has_r"), F.col(f"r_{n}")).otherwise(profile[n]).alias(n) for n in SHORT])


def arrival_profile(links: DataFrame, recent: DataFrame, profiled: DataFrame, entries: DataFrame, rows: int = 100, rate_rows: int = 10) -> DataFrame:
    """Adds rate, out_queue, transfer, queue and size to ``links`` (stream, sender, receiver, model).

    ``rate``: the largest rate of the stream's newest recent row, else the largest of the model's newest ``rate_rows`` profiled ones. The others: exact 95th percentiles over a link's newest
    recent rows, else over those profiled for the receiver and the model, with the transfer of that size by the link's entries.
    """
    p95 = lambda c: nearest_rank(c).cast("long")
    rate = greatest_of("arrival_rate", F.col)
    now_rate = recent.groupBy("stream").agg(F.max_by(rate, F.struct("timestamps", "event_id")).alias("r_rate"))
    then_rate = newest(profiled, ["model"], rate_rows).groupBy("model").agg(F.max(rate).alias("p_rate"))
    now = _largest(recent, ["stream", "sender", "receiver"], rows, p95, "r")
    then = _largest(profiled, ["receiver", "model"], rows, p95, "p", ("out_queue", "queue", "size"))
    out = links.join(now_rate, "stream", "left").join(then_rate, "model", "left").join(now, ["stream", "sender", "receiver"], "left").join(then, ["receiver", "model"], "left")
    out = _transfers(out, entries)
    profile = {n: F.col("latency" if n == "transfer" else f"p_{n}") for n in SHORT}
    chosen = [F.when(F.col("has_r"), F.col(f"r_{n}")).otherwise(profile[n]).alias(n) for n in SHORT]
    return out.select(*links.columns, F.coalesce("r_rate", "p_rate").alias("rate"), *chosen)


def pre_post_latency(recent: DataFrame, profiled: DataFrame, keys: list[str], least: int = 3, factor: float = 1.005) -> DataFrame:
    """Percentiles per key and batch size; keys with fewer than ``least`` recent rows take profiled ones, inference per item times ``factor``."""
    p95 = lambda: [nearest_rank(f"p95_{s}_duration_us").cast("double").alias(s) for s in ("prep", "infer", "post")]
    group = [*keys, "infer_batch_size"]
    now = recent.groupBy(*group).agg(*p95(), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) | (F.col("infer_batch_size") <= 0)).drop("n")
    then = profiled.groupBy(*group).agg(*p95()).withColumn("infer", F.col("infer") / F.col("infer_batch_size") * factor)
    return now.unionByName(then.join(now.select(*group), group, "left_anti"))


def batch_infer_latency(process: DataFrame, keys: list[str]) -> DataFrame:
    """Inference time per item: 95th percentile over batch size."""
    group = [*keys, "infer_batch_size"]
    return process.groupBy(*group).agg((nearest_rank("p95_infer_duration_us") / F.col("infer_batch_size")).alias("infer"))


def resource_requirements(hw: DataFrame, keys: list[str]) -> DataFrame:
    return hw.groupBy(*keys, "batch_size").agg(*[F.max(c).alias(c) for c in ("cpu_usage", "mem_usage", "rss_mem_usage", "gpu_usage", "gpu_mem_usage")])


def estimate_latency(sizes: DataFrame, entries: DataFrame, size: str, mode: str = "max", width: int = 1024, keys: list[str] | None = None) -> DataFrame:
    """Adds latency of a package size from the (pkg_size, latency) entries of its ``keys`` (a link): clamped at the ends; between two, the larger (or linear).

    Every size takes the last entry at or below it by an as-of join in buckets of ``width`` bytes. Without entries or size it is null.
    """
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy("pkg_size")  # one row per distinct size of a link
    step = F.struct("pkg_size", "latency", F.lead("pkg_size").over(w).alias("next_size"), F.lead("latency").over(w).alias("next_latency"))
    steps = entries.select(*keys, F.col("pkg_size").alias(size), step.alias("step_"))
    first = entries.groupBy(*keys).agg(F.min_by("latency", "pkg_size").alias("first_"))
    s, at = F.col(size), lambda name: F.col(f"step_.{name}")
    share = (s - at("pkg_size")) / (at("next_size") - at("pkg_size"))
    inside = F.greatest(at("latency"), at("next_latency")) if mode == "max" else at("latency") + share * (at("next_latency") - at("latency"))
    value = F.when(s.isNull(), None).when(F.col("step_").isNull(), F.col("first_")).when(at("next_size").isNull() | (s <= at("pkg_size")), at("latency")).otherwise(inside)
    found = as_of(sizes, steps, keys, size, "step_", width)
    found = found.join(first, keys, "left") if keys else found.crossJoin(F.broadcast(first))  # one row
    return found.select(*sizes.columns, value.alias("latency"))


def network_entries(samples: DataFrame, size: str, latency: str, longest: int = 10_000_000, keys: list[str] | None = None) -> DataFrame:
    return samples.where(F.col(latency) <= longest).groupBy(*(keys or []), F.col(size).alias("pkg_size")).agg(nearest_rank(latency).cast("long").alias("latency"))


def full_profile(prep: DataFrame, batch: DataFrame, hw: DataFrame) -> DataFrame:
    """Outer join by batch size of stage times, batch times and resources; times fill each other's gaps. Adds max_batch."""
    b = batch.select("batch_size", F.col("infer").alias("infer_b"))
    out = prep.join(b, "batch_size", "full").join(hw, "batch_size", "full").withColumn("infer", F.coalesce("infer", "infer_b")).drop("infer_b")
    return out.crossJoin(F.broadcast(out.agg(F.max("batch_size").alias("max_batch"))))  # one row


def representative_latency(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Latency of the first size at or above the middle of the size range; 0 where there is none."""
    mid = entries.groupBy(*keys).agg(((F.min("pkg_size") + F.max("pkg_size")) / 2).alias("mid_"))
    pick = F.min_by(F.when(F.col("pkg_size") >= F.col("mid_"), F.col("latency")), F.when(F.col("pkg_size") >= F.col("mid_"), F.col("pkg_size")))
    return entries.join(mid, keys).groupBy(*keys).agg(F.coalesce(pick, F.lit(0)).alias("latency"))


def history(df: DataFrame, keys: list[str], order: list[str], value: str, back: int) -> DataFrame:
    """Adds window: the last ``back`` + 1 values."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, 0)
    return df.withColumn("window", F.collect_list(value).over(w))


def supervised(df: DataFrame, keys: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """Full windows of ``length`` values (x) with the next value (y)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, *order, F.collect_list(value).over(w.rowsBetween(1 - length, 0)).alias("x"), F.lead(value).over(w).alias("y"))
    return rows.where((F.size("x") == length) & F.col("y").isNotNull())


def training_batches(windows: DataFrame, tie: str, size: int = 64, seed: int = 0) -> DataFrame:
    """Windows in a random order (by hash), with the number of their batch of ``size``; numbered without a window over all of them."""
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.col(tie))), F.col(tie)]
    return numbered(windows, [], order, "rn_").withColumn("batch", F.floor((F.col("rn_") - 1) / size)).drop("rn_")
