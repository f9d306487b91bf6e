"""Roll-ups from request timestamps (t0..t11, microseconds) to metrics."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import PERIODS
from ..functions.quantiles import floor_index


def _ordered(names: list[str], strict: bool) -> Column:
    pairs = zip(names, names[1:], strict=False)
    return reduce(and_, [(F.col(b) > F.col(a)) if strict else (F.col(b) >= F.col(a)) for a, b in pairs])


def arrival_durations(requests: DataFrame) -> DataFrame:
    """Adds out_queue, transfer, in_queue; rows whose t1..t4 decrease are dropped."""
    good = requests.where(_ordered(["t1", "t2", "t3", "t4"], strict=False))
    return good.withColumns({"out_queue": F.col("t2") - F.col("t1"), "transfer": F.col("t3") - F.col("t2"), "in_queue": F.col("t4") - F.col("t3")})


def process_durations(requests: DataFrame) -> DataFrame:
    """Adds prep, batch, infer_queue, infer, post; rows whose t4..t11 do not strictly increase are dropped."""
    good = requests.where(_ordered([f"t{i}" for i in range(4, 12)], strict=True))
    gap = lambda a, b: F.col(f"t{b}") - F.col(f"t{a}")
    return good.withColumns({"prep": gap(4, 5), "batch": gap(5, 6), "infer_queue": gap(6, 7), "infer": gap(7, 8), "post": gap(9, 11)})


def summary(df: DataFrame, keys: list[str], values: list[str], least: int = 1) -> DataFrame:
    """Floor-index 95th percentile of every value per group of at least ``least`` rows, and the number of rows."""
    return floor_index(df, keys, values).where(F.col("n") >= least)


def network_summary(durations: DataFrame) -> DataFrame:
    """Per sender the largest of its streams' percentiles."""
    return summary(durations, ["stream", "sender_host"], ["transfer", "v"]).groupBy("sender_host").agg(F.max("transfer").alias("p95_transfer"), F.max("v").alias("p95_size"))


def per_second(requests: DataFrame, keys: list[str], at: str = "t0", tie: str = "event_id", second: int = 1_000_000) -> DataFrame:
    """Requests per second, and mean and population variance of the gaps between them.

    The first request of a second has no gap and negative gaps count for nothing; seconds without gaps have mean and variance 0.
    """
    df = requests.withColumn("second", F.floor(F.col(at) / second).cast("long"))
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*keys, "second").orderBy(at, tie))
    df = df.withColumn("gap", F.when(gap >= 0, gap).cast("double"))
    zero = F.lit(0.0)
    return df.groupBy(*keys, "second").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("gap"), zero).alias("mean"), F.coalesce(F.var_pop("gap"), zero).alias("variance"))


def combine_receivers(seconds: DataFrame, keys: list[str]) -> DataFrame:
    """One record per second from those of several receivers: sum of counts, plain mean of the means and variances that are not 0."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c))), F.lit(0.0))
    return seconds.groupBy(*keys, "second").agg(F.sum("n").alias("n"), mean("mean").alias("mean"), mean("variance").alias("variance"))


def period_rates(seconds: DataFrame, keys: list[str], periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """Adds arrival_rate_{p}s = ceil(requests of the last p seconds / p) to every second."""
    frame = lambda p: Window.partitionBy(*keys).orderBy("second").rangeBetween(-(p - 1), 0)
    return seconds.withColumns({f"arrival_rate_{p}s": F.ceil(F.sum("n").over(frame(p)) / p).cast("long") for p in periods})


def period_variation(seconds: DataFrame, keys: list[str], periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """Adds coeff_var_{p}s from the pooled mean and variance of the last p seconds; 0 where there is no mean."""
    n, m, v = F.col("n"), F.col("mean"), F.col("variance")

    def variation(p: int) -> Column:
        w = Window.partitionBy(*keys).orderBy("second").rangeBetween(-(p - 1), 0)
        total = F.sum(n).over(w)
        mean = F.sum(n * m).over(w) / total
        var = F.greatest(F.sum(n * (v + m * m)).over(w) / total - mean * mean, F.lit(0.0))
        return F.when(mean > 0, F.sqrt(var) / mean).otherwise(0.0)

    return seconds.withColumns({f"coeff_var_{p}s": variation(p) for p in periods})


def throughput(requests: DataFrame, keys: list[str], at: str = "t11", second: int = 1_000_000, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """Completions of the last p seconds before the newest, per second, plus 1."""
    last = requests.groupBy(*keys).agg(F.max(at).alias("last_"))
    age = F.col("last_") - F.col(at)
    counts = [(F.count_if(age <= p * second) / p + 1).alias(f"thrput_{p}s") for p in periods]
    return requests.join(last, keys).groupBy(*keys).agg(*counts)


def late(requests: DataFrame, budget: int = 0) -> Column:
    """Whether a request is older at receipt than its SLO less the time budget left."""
    return (F.col("t3") - F.col("t0")) > (F.col("slo") - budget)


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, up: float, down: float, start: float | None = None) -> DataFrame:
    """Last value of s := keep * s + (1 - keep) * x per group, where ``keep`` is ``up`` for a rise and ``down`` else.

    Each step shrinks what came before by at most ``max(up, down)``, which must be below 1, so the last rows, as many as
    shrink it to 1e-24, give the full fold to double precision; only those are gathered (248 at 0.8).
    """
    most = max(up, down)
    if not 0 <= min(up, down) <= most < 1:
        raise ValueError("up and down must be at least 0 and below 1")
    rows = math.ceil(math.log(1e-24) / math.log(most)) + 1 if most > 0 else 1
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = df.select(*keys, *order, value).withColumn("rn_", F.row_number().over(newest)).where(F.col("rn_") <= rows)
    xs = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("x_")))), lambda s: s["x_"])
    step = lambda s, x: F.when(s.isNull(), x).when(x > s, s * up + x * (1 - up)).otherwise(s * down + x * (1 - down))
    return last.groupBy(*keys).agg(F.aggregate(xs, F.lit(start).cast("double"), step).alias("smoothed"))


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The newest row's values per group."""
    pick = F.max_by(F.struct(*values), F.struct(*order)).alias("row_")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"row_.{v}").alias(v) for v in values])


def cpu_percent(df: DataFrame, keys: list[str], order: list[str], active: str, total: str, back: int = 10) -> DataFrame:
    """Adds cpu: 100 * change of ``active`` / change of ``total`` against ``back`` samples before, as a whole number; 0 where undefined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    da, dt = F.col(active) - F.lag(active, back).over(w), F.col(total) - F.lag(total, back).over(w)
    return df.withColumn("cpu", F.coalesce(F.when(dt != 0, F.floor(F.abs(100 * da / dt)) * F.signum(da / dt)), F.lit(0)).cast("long"))


def class_counts(detections: DataFrame, frames: DataFrame, least: float = 0.25) -> DataFrame:
    """person (0), car (2) and other detections per frame; frames without any have zeros."""
    c = F.col("class_id")
    counts = detections.where(F.col("score") >= least).groupBy("image_id").agg(F.count_if(c == 0).alias("person"), F.count_if(c == 2).alias("car"), F.count_if(~c.isin(0, 2)).alias("others"))
    return frames.select("image_id").distinct().join(counts, "image_id", "left").fillna(0, ["person", "car", "others"])


def initial_rates(counts: DataFrame, fps: int = 15, boundary: int = 30) -> DataFrame:
    """Request rate per model from the peak running average of objects per second at every ``boundary`` frames."""
    total = F.sum("objects").over(Window.partitionBy("stream").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    seconds = (F.col("frame") + 1) / boundary
    peaks = counts.withColumn("average", total / seconds).where((F.col("frame") + 1) % boundary == 0).groupBy("stream").agg(F.max("average").alias("peak"))
    return peaks.select("stream", F.ceil(F.greatest(F.col("peak") * 1.2 * fps / 30 + 1, F.lit(float(fps)))).cast("long").alias("rate"))


def mean_mahalanobis(df: DataFrame, held: DataFrame, columns: list[str], ridge: float = 1e-6) -> DataFrame:
    """Adds distance: the mean Mahalanobis distance of a row from the rows of ``held`` under their covariance (plus ``ridge`` on its diagonal).

    ``held`` is a buffer of bounded capacity: its rows reach the driver, which whitens them by the Cholesky factor of the inverse covariance. Whitened, the
    distance is Euclidean, and every row meets the buffer as one array: a join with one row.
    """
    import numpy as np

    buffer = np.array([[float(v) for v in r] for r in held.select(*columns).dropna().collect()]).reshape(-1, len(columns))
    if len(buffer) < 2:
        return df.withColumn("distance", F.lit(None).cast("double"))
    turn = np.linalg.cholesky(np.linalg.inv(np.cov(buffer, rowvar=False).reshape(len(columns), -1) + ridge * np.eye(len(columns))))
    packed = df.sparkSession.createDataFrame([((buffer @ turn).tolist(),)], "held_ array<array<double>>")
    own = F.array(*[reduce(lambda s, t: s + t, [F.col(c).cast("double") * float(turn[i, j]) for i, c in enumerate(columns)]) for j in range(len(columns))])
    apart = lambda r: F.sqrt(F.aggregate(F.zip_with("own_", r, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    met = df.withColumn("own_", own).crossJoin(F.broadcast(packed))  # one row
    total = F.aggregate("held_", F.lit(0.0), lambda s, r: s + apart(r))
    return met.withColumn("distance", total / len(buffer)).drop("own_", "held_")
