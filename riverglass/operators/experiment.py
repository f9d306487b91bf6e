"""Experiment analysis: aligned and smoothed series, throughput and goodput, workload against achievement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import align


def align_series(tables: list[DataFrame], at: str, values: list[str], keys: list[str] | None = None, width: int = 1_000_000) -> DataFrame:
    """Union of the tables in bins of ``width``: sums of the values, and minutes since the first bin of a key."""
    keys = keys or []
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    bins = both.groupBy(*keys, align(F.col(at), width).alias("bin")).agg(*[F.sum(v).alias(v) for v in values])
    first = bins.groupBy(*keys).agg(F.min("bin").alias("first_"))
    rows = bins.join(first, keys) if keys else bins.crossJoin(F.broadcast(first))  # one row
    return rows.withColumn("minutes", (F.col("bin") - F.col("first_")) / 60e6).drop("first_")


def bucket_smooth(df: DataFrame, keys: list[str], at: str, values: list[str], buckets: int, window: int) -> DataFrame:
    """Equal-width right-closed buckets of time per key: first time, means, and their rolling means over the non-empty buckets.

    The least time falls into the first bucket; times that are all equal fall into the middle one.
    """
    ends = df.groupBy(*keys).agg(F.min(at).alias("low_"), F.max(at).alias("high_"))
    width = (F.col("high_") - F.col("low_")) / buckets
    index = F.when(width == 0, F.lit(-(-buckets // 2) - 1)).otherwise(F.greatest(F.lit(0), F.ceil((F.col(at) - F.col("low_")) / width) - 1))
    rows = (df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))).withColumn("bucket", index.cast("long"))  # one row without keys
    per = rows.groupBy(*keys, "bucket").agg(F.min(at).alias("first"), *[F.avg(v).alias(v) for v in values])
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(-(window - 1), 0)
    return per.withColumns({f"{v}_smooth": F.avg(v).over(w) for v in values})


def combined(log: DataFrame, expected: DataFrame, seconds: Column, target_us: int = 200_000, people_extra_us: int = 100_000) -> DataFrame:
    """Per system: throughput, goodput, mean latency in ms and share of expected objects, per second."""
    target = F.lit(target_us) + F.when(F.col("class") == "people", people_extra_us).otherwise(0)
    per = log.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("latency_us") < target).alias("good"), (F.avg("latency_us") / 1000).alias("latency_ms"))
    return per.join(expected, "system", "left").select("system", F.col("n").alias("n_objects"), (F.col("n") / seconds).alias("throughput"), (F.col("good") / seconds).alias("goodput"), F.coalesce("latency_ms", F.lit(1.0)).alias("latency_ms"), (F.least(F.col("n") / F.col("expected") * 100, F.lit(100.0)) / seconds).alias("max_throughput"))


def split(log: DataFrame, expected: DataFrame, seconds: float = 1800, results: int = 1, target_us: int = 200_000, people_extra_us: int = 100_000) -> DataFrame:
    """Per system, pipeline and class (cars, people, total): arrived and in-time percent of the expected objects, capped at 100, throughput and goodput per second, and mean latency in ms.

    The surveillance pipeline has no cars (they count in its total percentages only), and its target is ``people_extra_us`` later. All counts are per repeated run (``results``).
    """
    car, surveillance = F.col("class") == "cars", F.col("pipeline") == "people"
    target = F.lit(target_us) + F.when(surveillance, people_extra_us).otherwise(0)
    good, late = F.col("latency_us") < target, F.col("latency_us") / 1000
    count = lambda c: F.count_if(c) / results
    per = log.groupBy("system", "pipeline").agg(
        count(car).alias("n_c"), count(~car).alias("n_p"), count(car & good).alias("g_c"), count(~car & good).alias("g_p"),
        F.count_if(car).alias("all_c"), F.count_if(~car).alias("all_p"), F.sum(F.when(car & ~surveillance, late).otherwise(F.when(car, 0.0))).alias("l_c"), F.sum(F.when(~car, late)).alias("l_p"),
    )
    want = expected.groupBy("pipeline").agg(F.max(F.when(car, F.col("expected"))).alias("e_c"), F.max(F.when(~car, F.col("expected"))).alias("e_p"))
    c, zero = F.col, F.lit(0.0)
    percent = lambda n, e: F.coalesce(F.least(F.lit(100.0), F.try_divide(100.0 * n, e)), zero)
    alone = lambda x: F.when(surveillance, zero).otherwise(x)
    both_e = F.when(surveillance, c("e_p")).otherwise(c("e_c") + c("e_p"))
    mean = lambda total, n: F.try_divide(total, n)

    def row(name: str, *figures: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), *[x.cast("double").alias(n) for n, x in zip(("arrived", "in_time", "throughput", "goodput", "latency_ms"), figures, strict=True)])

    cars = row("cars", alone(percent(c("n_c"), c("e_c"))), alone(percent(c("g_c"), c("e_c"))), alone(c("n_c") / seconds), alone(c("g_c") / seconds), mean(c("l_c"), c("all_c")))
    people = row("people", percent(c("n_p"), c("e_p")), percent(c("g_p"), c("e_p")), c("n_p") / seconds, c("g_p") / seconds, mean(c("l_p"), c("all_p")))
    total = row(
        "total", percent(c("n_c") + c("n_p"), both_e), percent(c("g_c") + c("g_p"), both_e), (alone(c("n_c")) + c("n_p")) / seconds, (alone(c("g_c")) + c("g_p")) / seconds,
        mean(F.coalesce("l_c", zero) + F.coalesce("l_p", zero), c("all_c") + c("all_p")),
    )
    return per.join(want, "pipeline", "left").select("system", "pipeline", F.inline(F.array(cars, people, total)))


def expected_totals(counts: DataFrame, thirty_fps: Column) -> DataFrame:
    """Expected objects per pipeline and class from counted people and cars, by the pipelines' weights."""
    f = F.when(thirty_fps, 1.0).otherwise(0.5)
    total = lambda c, weight: F.sum(F.col(c) * f * weight)
    one = counts.groupBy("pipeline").agg(F.when(F.col("pipeline") == "traffic", total("people", 0.5)).otherwise(total("people", 2.5)).alias("people"), F.when(F.col("pipeline") == "traffic", total("cars", 2.0)).otherwise(0.0).alias("cars"))
    return one.select("pipeline", F.explode(F.array(F.struct(F.lit("people").alias("class"), F.col("people").alias("expected")), F.struct(F.lit("cars").alias("class"), F.col("cars").alias("expected")))).alias("e")).select("pipeline", "e.*")


def box_plot(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the extreme values within 1.5 times the interquartile range."""
    q = df.groupBy(*keys).agg(*[F.percentile(value, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return df.join(q, keys).groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))


def second_series(log: DataFrame, keys: list[str], at: str = "arrival_us", width: int = 1_000_000, bound: int = 250_000) -> DataFrame:
    """Per bin: requests, mean latency, and share below ``bound``."""
    per = log.groupBy(*keys, align(F.col(at), width).alias("bin"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("latency_us").alias("latency_us"), (F.count_if(F.col("latency_us") < bound) / F.count(F.lit(1))).alias("goodput_ratio"))


def blended(series: DataFrame) -> DataFrame:
    """Adds throughput: the mean of the counted rate and the rate that latency and concurrency imply."""
    return series.withColumn("throughput", (F.col("n") + F.lit(1e6) / F.greatest(F.col("latency_us"), F.lit(1.0)) * F.col("n")) / 2)


def overall_series(log: DataFrame, keys: list[str], width: int = 1_000_000, bound: int = 250_000, buckets: int = 780, window: int = 3) -> DataFrame:
    """Requests per bin in smoothed buckets, with mean latency, and per key their mean (avg_throughput) and that times the share of requests below ``bound`` (avg_goodput)."""
    series = bucket_smooth(second_series(log, keys, width=width, bound=bound), keys, "bin", ["n", "latency_us"], buckets, window)
    ratio = log.groupBy(*keys).agg((F.count_if(F.col("latency_us") < bound) / F.count(F.lit(1))).alias("ratio_"))
    means = series.groupBy(*keys).agg(F.avg("n_smooth").alias("avg_throughput")).join(ratio, keys)
    means = means.select(*keys, "avg_throughput", (F.col("avg_throughput") * F.col("ratio_")).alias("avg_goodput"))
    return series.join(means, keys).select(*keys, "bucket", "first", F.col("n_smooth").alias("throughput"), F.col("latency_us_smooth").alias("latency_us"), "avg_throughput", "avg_goodput")


def prepared_series(log: DataFrame, keys: list[str], width: int = 1_000_000, bound: int = 200_000, buckets: int = 180, window: int = 3, upto: int = 30) -> DataFrame:
    """Minutes and blended throughput of the requests below ``bound``, in smoothed buckets, each key's series padded with zeros at its start so that it ends at ``upto`` minutes."""
    series = bucket_smooth(blended(second_series(log.where(F.col("latency_us") < bound), keys, width=width)), keys, "bin", ["throughput"], buckets, window)
    first = series.groupBy(*keys).agg(F.min("first").alias("start_"))
    series = series.join(first, keys).select(*keys, ((F.col("first") - F.col("start_")) / 60e6).alias("minutes"), F.col("throughput_smooth").alias("throughput"))
    return left_padded(series, "minutes", ["throughput"], upto, keys)


def left_padded(series: DataFrame, minutes: str, values: list[str], upto: int, keys: list[str] | None = None) -> DataFrame:
    """Zero rows in whole minutes before the series of each key, so that it ends at ``upto``."""
    keys = keys or []
    last = series.groupBy(*keys).agg(F.max(minutes).alias("last_"))
    missing = F.greatest(F.lit(0), F.ceil(F.lit(upto) - F.col("last_")))
    pad = last.where(missing > 0).select(*keys, F.explode(F.sequence(F.lit(1), missing.cast("int"))).alias("i")).select(*keys, (-F.col("i")).cast("double").alias(minutes), *[F.lit(0.0).alias(v) for v in values])
    return series.select(*keys, minutes, *values).unionByName(pad)


def missed(joined: DataFrame, keys: list[str]) -> DataFrame:
    """From workload and throughput at the nearest time: sum of what was missed, and the workload raised to what was achieved."""
    gap = F.greatest(F.lit(0.0), F.col("workload") - F.col("throughput"))
    return joined.groupBy(*keys).agg(F.sum(gap).alias("missed"), F.sum(F.greatest("workload", "throughput")).alias("workload"))


def fill_gaps(series: DataFrame, keys: list[str], at: str, values: list[str], gap: float = 1.0) -> DataFrame:
    """After every row whose next is more than ``gap`` later, a zero row ``gap`` after it."""
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    holes = series.withColumn("next_", following).where(F.col("next_") - F.col(at) > gap)
    zero = holes.select(*keys, (F.col(at) + gap).alias(at), *[F.lit(0).cast(series.schema[v].dataType).alias(v) for v in values])
    return series.select(*keys, at, *values).unionByName(zero)


def workload(counts: DataFrame, keys: list[str], frames: int, halve: Column) -> DataFrame:
    """Objects per second in buckets of ``frames`` frames (30 a second); people are halved (whole numbers) where ``halve``; the open last bucket goes."""
    people = F.when(halve, F.floor(F.col("person") / 2)).otherwise(F.col("person"))
    bucket = F.floor(F.col("frame") / frames)
    per = counts.withColumn("objects", people + F.col("car")).groupBy(*keys, bucket.alias("bucket")).agg(F.sum("objects").alias("s"), F.max("frame").alias("f"))
    last = per.groupBy(*keys).agg(F.max("f").alias("end_"))
    full = per.join(last, keys).where((F.col("bucket") + 1) * frames <= F.col("end_") + 1)
    return full.select(*keys, "bucket", (F.col("s") / (frames / 30)).alias("workload"))


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Means of full windows of ``n`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({"rn_": F.row_number().over(w), "average": F.avg(value).over(w.rowsBetween(-(n - 1), 0))})
    return out.where(F.col("rn_") >= n).drop("rn_")


def average_tail(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, blend: int = 10) -> DataFrame:
    """``n`` - 1 further averages per series (i from 1): each blends the mean of the last, ever shorter, window with the ``blend`` averages before it.

    Only the last ``n`` + ``blend`` - 1 rows of a series count, so that is all a group holds. Series shorter than ``n`` have no tail.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = df.select(*keys, *order, value).withColumn("rn_", F.row_number().over(newest)).where(F.col("rn_") < n + blend)

    def tail(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.sort_values("rn_", ascending=False)[value].to_numpy(np.float64)
        averages = [float(a[i : i + n].mean()) for i in range(len(a) - n + 1)]
        for i in range(n - 1 if averages else 0):
            known = averages[-blend:]
            averages.append((float(a[-(n - i) :].mean()) + sum(known)) / (len(known) + 1))
        added = averages[len(averages) - (n - 1) :] if averages else []
        first = pdf[keys].iloc[[0] * len(added)].reset_index(drop=True)
        return first.assign(i=np.arange(1, len(added) + 1, dtype=np.int64), average=np.array(added, np.float64))

    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return last.groupBy(*keys).applyInPandas(tail, f"{head}, i long, average double")


def success_rate(df: DataFrame) -> DataFrame:
    return df.withColumns({"throughput_pct": F.col("throughput") / F.col("most") * 100, "goodput_pct": F.col("goodput") / F.col("most") * 100})


def run_seconds(experiment: Column, default: int = 1800) -> Column:
    """Seconds of a run by its name: fixed values of the two long experiments."""
    return F.when(experiment.contains("fcty"), 2160).when(experiment.contains("camp"), 7200).otherwise(default).cast("long")


def learning_curve(steps: DataFrame, agent: str, instance: str, order: list[str], values: list[str]) -> DataFrame:
    """Per position: the values' means over an agent's instances, then over agents; those too short for a position count as nothing, as in the sums of all."""
    pos = F.row_number().over(Window.partitionBy(agent, instance).orderBy(*order)).cast("long")
    runs = steps.groupBy(agent).agg(F.count_distinct(instance).alias("runs_"))
    per = steps.withColumn("pos", pos).groupBy(agent, "pos").agg(*[F.sum(v).alias(v) for v in values]).join(runs, agent)
    agents = runs.agg(F.count(F.lit(1)).alias("agents_"))
    curve = per.groupBy("pos").agg(*[F.sum(F.col(v) / F.col("runs_")).alias(v) for v in values]).crossJoin(F.broadcast(agents))  # one row
    return curve.select("pos", *[(F.col(v) / F.col("agents_")).alias(v) for v in values])
