"""Trace roll-ups (family C). The fixture's events are sparse, so a second here is a thousand real ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import PERIODS
from ..functions import quantiles as Q
from ..operators import rollup as R
from ..session import stored
from .registry import query

SECOND = 1_000_000_000
GOOD = "t2 >= t1 AND t3 >= t2 AND t4 >= t3"
STRICT = " AND ".join(f"t{i + 1} > t{i}" for i in range(4, 11))
DUR = f"SELECT *, t2 - t1 AS out_queue, t3 - t2 AS transfer, t4 - t3 AS in_queue FROM request WHERE {GOOD}"
PROC = f"SELECT *, t5 - t4 AS prep, t6 - t5 AS batch, t7 - t6 AS infer_queue, t8 - t7 AS infer, t11 - t9 AS post FROM request WHERE {STRICT}"
P95 = "list_sort(list({0}))[least(CAST(floor(count({0}) * 95 / 100) AS BIGINT), count({0}) - 1) + 1]".format
SEC = f"""gaps AS (SELECT stream, sender_host, CAST(floor(t0 / {SECOND}.0) AS BIGINT) AS second, t0 - lag(t0) OVER (PARTITION BY stream, sender_host, floor(t0 / {SECOND}.0) ORDER BY t0, event_id) AS gap FROM request),
sec AS (SELECT stream, sender_host, second, count(*) AS n, coalesce(avg(gap) FILTER (gap >= 0), 0) AS mean, coalesce(var_pop(gap) FILTER (gap >= 0), 0) AS variance FROM gaps GROUP BY ALL)"""
COMB = f"{SEC}, comb AS (SELECT stream, second, CAST(sum(n) AS BIGINT) AS n, coalesce(avg(mean) FILTER (mean <> 0), 0) AS mean, coalesce(avg(variance) FILTER (variance <> 0), 0) AS variance FROM sec GROUP BY ALL)"


def seconds(d):
    return R.per_second(d.request, ["stream", "sender_host"], second=SECOND)


def combined(d):
    return R.combine_receivers(seconds(d), ["stream"])


@query("c1_arrival_durations", f"SELECT event_id, out_queue, transfer, in_queue FROM ({DUR})")
def c1(d):
    return R.arrival_durations(d.request).select("event_id", "out_queue", "transfer", "in_queue")


@query("c2_process_durations", f"SELECT event_id, prep, batch, infer_queue, infer, post FROM ({PROC})")
def c2(d):
    return R.process_durations(d.request).select("event_id", "prep", "batch", "infer_queue", "infer", "post")


@query("c3_merge_records", f"SELECT stream, sender_host, count(*) AS n, CAST(sum(transfer) AS BIGINT) AS transfer FROM ({DUR}) GROUP BY ALL")
def c3(d):
    parts = [R.arrival_durations(d.request.where(F.col("event_id") % 3 == i)) for i in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("stream", "sender_host").agg(F.count(F.lit(1)).alias("n"), F.sum("transfer").alias("transfer"))


@query("c4_p95_nearest_rank", "SELECT stream, quantile_disc(v, 0.95) AS p95 FROM request GROUP BY stream")
def c4(d):
    return d.request.groupBy("stream").agg(Q.nearest_rank("v").cast("long").alias("p95"))


@query("c5_p95_floor_index", f"SELECT stream, {P95('v')} AS p95, count(v) AS n FROM request GROUP BY stream")
def c5(d):
    return Q.floor_index(d.request, ["stream"], ["v"]).select("stream", F.col("v").alias("p95"), "n")


@query("c6_percentile_disc", "SELECT stream, infer_batch_size, quantile_disc(p95_infer_duration_us, 0.95) AS p95 FROM process GROUP BY ALL")
def c6(d):
    return d.process.groupBy("stream", "infer_batch_size").agg(Q.nearest_rank("p95_infer_duration_us").cast("long").alias("p95"))


@query("c6_sketched_percentiles", "SELECT stream, model_name, count(*) AS n, true AS p50_close, true AS p95_close FROM process GROUP BY ALL")
def c6_sketched(d):
    """Hourly sketches, stored and merged per stream and model; whether the exact rank of each result is within twice the sketch's error of the asked one."""
    hour = F.floor(F.col("timestamps") / 3_600_000_000).alias("hour")
    rows = d.process.select("stream", "model_name", hour, F.col("p95_infer_duration_us").alias("x"))
    parts = stored(Q.sketches(rows, ["stream", "model_name", "hour"], "x"), "sketches")
    found = Q.merged(parts, ["stream", "model_name"], {"p50": 0.5, "p95": 0.95})
    met = rows.join(found, ["stream", "model_name"]).groupBy("stream", "model_name").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("x") < F.col(p)).alias(f"{p}_below") for p in ("p50", "p95")], *[F.count_if(F.col("x") <= F.col(p)).alias(f"{p}_upto") for p in ("p50", "p95")])
    close = lambda p, r: ((F.col(f"{p}_below") / F.col("n") <= r + 2 * Q.RANK_ERROR) & (F.col(f"{p}_upto") / F.col("n") >= r - 2 * Q.RANK_ERROR)).alias(f"{p}_close")
    return met.select("stream", "model_name", "n", close("p50", 0.5), close("p95", 0.95))


@query("c7_arrival_summary", f"SELECT stream, sender_host, count(*) AS n, {P95('out_queue')} AS out_queue, {P95('transfer')} AS transfer, {P95('in_queue')} AS in_queue, {P95('v')} AS v FROM ({DUR}) GROUP BY ALL")
def c7(d):
    return R.summary(R.arrival_durations(d.request), ["stream", "sender_host"], ["out_queue", "transfer", "in_queue", "v"])


SEVEN = ("prep", "batch", "infer", "post", "input_size", "output_size", "encoded_size")
SIZES = {"input_size": "1000 + v % 900", "output_size": "300 + v % 700", "encoded_size": "100 + v % 80"}


@query("c8_process_summary", f"SELECT day, stream, infer_batch_size, count(*) AS n, {', '.join(f'{P95(c)} AS {c}' for c in SEVEN)} FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in SIZES.items())} FROM ({PROC})) GROUP BY day, stream, infer_batch_size HAVING count(*) >= 20")
def c8(d):
    rows = R.process_durations(d.request).withColumns({n: F.expr(e) for n, e in SIZES.items()})
    return R.summary(rows, ["day", "stream", "infer_batch_size"], list(SEVEN), least=20)


@query("c9_batch_infer_summary", f"SELECT stream, infer_batch_size, count(*) AS n, {P95('infer')} AS infer FROM ({PROC}) GROUP BY ALL")
def c9(d):
    return R.summary(R.process_durations(d.request), ["stream", "infer_batch_size"], ["infer"])


@query("c10_network_summary", f"SELECT sender_host, max(transfer) AS p95_transfer, max(v) AS p95_size FROM (SELECT stream, sender_host, {P95('transfer')} AS transfer, {P95('v')} AS v FROM ({DUR}) GROUP BY ALL) GROUP BY sender_host")
def c10(d):
    return R.network_summary(R.arrival_durations(d.request))


@query("c11_per_second_arrivals", f"WITH {SEC} SELECT * FROM sec")
def c11(d):
    return seconds(d)


@query("c12_combine_receivers", f"WITH {COMB} SELECT * FROM comb")
def c12(d):
    return combined(d)


@query("c13_period_rates", f"WITH {COMB} SELECT stream, second, " + ", ".join(f"CAST(ceil(sum(n) OVER (PARTITION BY stream ORDER BY second RANGE BETWEEN {p - 1} PRECEDING AND CURRENT ROW) / {p}.0::DOUBLE) AS BIGINT) AS arrival_rate_{p}s" for p in PERIODS) + " FROM comb")
def c13(d):
    return R.period_rates(combined(d), ["stream"]).select("stream", "second", *[f"arrival_rate_{p}s" for p in PERIODS])


def _cv_sql(p: int) -> str:
    w = f"OVER (PARTITION BY stream ORDER BY second RANGE BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    m = f"(sum(n * mean) {w} / sum(n) {w})"
    return f"round(CASE WHEN {m} > 0 THEN sqrt(greatest(sum(n * (variance + mean * mean)) {w} / sum(n) {w} - {m} * {m}, 0)) / {m} ELSE 0 END, 6) AS coeff_var_{p}s"


@query("c14_period_variation", f"WITH {COMB} SELECT stream, second, " + ", ".join(map(_cv_sql, (7, 60))) + " FROM comb")
def c14(d):
    out = R.period_variation(combined(d), ["stream"], (7, 60))
    return out.select("stream", "second", *[F.round(f"coeff_var_{p}s", 6).alias(f"coeff_var_{p}s") for p in (7, 60)])


@query("c15_mean_rate", "SELECT event_id, round((" + " + ".join(f"arrival_rate_{p}s" for p in PERIODS) + ") / 6, 6) AS rate FROM arrival")
def c15(d):
    total = sum((F.col(f"arrival_rate_{p}s") for p in PERIODS[1:]), F.col("arrival_rate_1s"))
    return d.arrival.select("event_id", F.round(total / len(PERIODS), 6).alias("rate"))


@query("c16_throughput", "WITH l AS (SELECT stream, max(t11) AS last FROM request GROUP BY stream) SELECT stream, " + ", ".join(f"count(*) FILTER (last - t11 <= {p * SECOND}) / {p}.0::DOUBLE + 1 AS thrput_{p}s" for p in PERIODS) + " FROM request JOIN l USING (stream) GROUP BY stream")
def c16(d):
    return R.throughput(d.request, ["stream"], second=SECOND)


@query("c17_late_requests", "SELECT stream, count(*) AS n, count(*) FILTER (t3 - t0 > slo - 50) AS late FROM request GROUP BY stream")
def c17(d):
    return d.request.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.count_if(R.late(d.request, 50)).alias("late"))


@query("c18_asymmetric_ewma", "SELECT stream, round(list_reduce(list(CAST(v AS DOUBLE) ORDER BY t0, event_id), lambda s, x: CASE WHEN x > s THEN 0.2 * s + 0.8 * x ELSE 0.8 * s + 0.2 * x END), 6) AS smoothed FROM request GROUP BY stream")
def c18(d):
    out = R.smoothed(d.request, ["stream"], ["t0", "event_id"], "v", up=0.2, down=0.8)
    return out.select("stream", F.round("smoothed", 6).alias("smoothed"))


@query("c19_exponential_smoothing", "SELECT stream, round(list_reduce(list_prepend(0.0::DOUBLE, list(CAST(v AS DOUBLE) ORDER BY t0, event_id)), lambda s, x: 0.4 * s + 0.6 * x), 6) AS smoothed FROM request GROUP BY stream")
def c19(d):
    out = R.smoothed(d.request, ["stream"], ["t0", "event_id"], "v", up=0.4, down=0.4, start=0.0)
    return out.select("stream", F.round("smoothed", 6).alias("smoothed"))


@query("c20_hw_report", "SELECT system, CAST(floor(timestamps / 15000000.0) AS BIGINT) AS report, max(cpu_usage) AS cpu, max(mem_usage) AS mem, max(rss_mem_usage) AS rss, max(gpu_usage) AS gpu, max(gpu_mem_usage) AS gpu_mem FROM hw GROUP BY ALL")
def c20(d):
    return d.hw.groupBy("system", F.floor(F.col("timestamps") / 15_000_000).alias("report")).agg(*[F.max(c).alias(n) for c, n in (("cpu_usage", "cpu"), ("mem_usage", "mem"), ("rss_mem_usage", "rss"), ("gpu_usage", "gpu"), ("gpu_mem_usage", "gpu_mem"))])


@query("c21_sink_report", f"SELECT system, CAST(floor(arrival_us / {SECOND}.0) AS BIGINT) AS second, count(*) AS n, CAST(sum(latency_us) AS DOUBLE) / count(*) AS latency FROM sink_log GROUP BY ALL")
def c21(d):
    return d.sink_log.groupBy("system", F.floor(F.col("arrival_us") / SECOND).alias("second")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("latency_us") / F.count(F.lit(1)), F.lit(0.0)).alias("latency"))


@query("c22_latest_metrics", "SELECT stream, sender_host, v, late_requests, queue_drops FROM (SELECT a.stream, a.sender_host, p95_queueing_duration_us AS v, late_requests, queue_drops, row_number() OVER (PARTITION BY stream, sender_host ORDER BY timestamps DESC, event_id DESC) AS rn FROM arrival a) WHERE rn = 1")
def c22(d):
    df = d.arrival.withColumnRenamed("p95_queueing_duration_us", "v")
    return R.latest(df, ["stream", "sender_host"], ["timestamps", "event_id"], ["v", "late_requests", "queue_drops"])


@query("c23_drop_totals", "SELECT stream, CAST(sum(late_requests) AS BIGINT) AS late, CAST(sum(queue_drops) AS BIGINT) AS drops FROM arrival GROUP BY stream")
def c23(d):
    return d.arrival.groupBy("stream").agg(F.sum("late_requests").alias("late"), F.sum("queue_drops").alias("drops"))


@query("c24_cpu_percent", "SELECT event_id, coalesce(CASE WHEN dt <> 0 THEN trunc(100.0::DOUBLE * da / dt) END, 0)::BIGINT AS cpu FROM (SELECT event_id, v - lag(v, 10) OVER w AS da, t0 - lag(t0, 10) OVER w AS dt FROM request WINDOW w AS (PARTITION BY user_id ORDER BY t0, event_id))")
def c24(d):
    return R.cpu_percent(d.request, ["user_id"], ["t0", "event_id"], "v", "t0").select("event_id", "cpu")


@query("c25_class_counts", "SELECT o_orderkey AS image_id, count(*) FILTER (class_id = 0 AND score >= 0.25) AS person, count(*) FILTER (class_id = 2 AND score >= 0.25) AS car, count(*) FILTER (class_id = 1 AND score >= 0.25) AS others FROM orders LEFT JOIN (SELECT * FROM detections WHERE class_id <> 1 OR image_id % 2 = 0) dt ON dt.image_id = o_orderkey GROUP BY 1")
def c25(d):
    """Every order is a frame, and those that hold no detection have zeros; odd frames report no others."""
    shown = d.detections.where("class_id <> 1 OR image_id % 2 = 0")
    return R.class_counts(shown, d.orders.select(F.col("o_orderkey").alias("image_id")))


@query("c26_initial_rates", "WITH f AS (SELECT class_id AS stream, x1 AS frame, count(*) AS objects FROM detections GROUP BY ALL), r AS (SELECT stream, frame, sum(objects) OVER (PARTITION BY stream ORDER BY frame) / ((frame + 1) / 30.0::DOUBLE) AS a FROM f) SELECT stream, CAST(ceil(greatest(max(a) * 1.2 * 15 / 30 + 1, 15)) AS BIGINT) AS rate FROM r WHERE (frame + 1) % 30 = 0 GROUP BY stream")
def c26(d):
    frames = d.detections.groupBy(F.col("class_id").alias("stream"), F.col("x1").alias("frame")).agg(F.count(F.lit(1)).alias("objects"))
    return R.initial_rates(frames)


@query(
    "c27_mahalanobis",
    """WITH r AS (SELECT obj1, obj2 FROM rollouts ORDER BY rollout_id LIMIT 200), m AS (SELECT covar_samp(obj1, obj1) + 1e-6 AS s11, covar_samp(obj1, obj2) AS s12, covar_samp(obj2, obj2) + 1e-6 AS s22 FROM r),
       e AS (SELECT x.rollout_id, avg(sqrt(greatest((s22 * (x.obj1 - r.obj1) ** 2 - 2 * s12 * (x.obj1 - r.obj1) * (x.obj2 - r.obj2) + s11 * (x.obj2 - r.obj2) ** 2) / (s11 * s22 - s12 * s12), 0))) AS d FROM rollouts x, r, m GROUP BY 1)
       SELECT rollout_id, round(d, 6) AS distance, 0.5 * d > 0.5 AS admitted FROM e""",
)
def c27(d):
    held = d.rollouts.orderBy("rollout_id").limit(200)  # the buffer's capacity
    out = R.mean_mahalanobis(d.rollouts, held, ["obj1", "obj2"])
    return out.select("rollout_id", F.round("distance", 6).alias("distance"), (0.5 * F.col("distance") > 0.5).alias("admitted"))
