"""Experiment analysis (family H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import experiment as X
from ..operators import joins as J
from ..session import scratch
from ..sources import readers as R
from .registry import query

HOUR = 3_600_000_000
BIN = f"CAST(floor(arrival_us / {HOUR}.0) AS BIGINT) * {HOUR}"


@query("h1_align_timestamps", f"WITH u AS (SELECT timestamps AS t, late_requests AS late, queue_drops AS drops FROM arrival UNION ALL SELECT timestamps, infer_batch_size, NULL FROM process), b AS (SELECT CAST(floor(t / {HOUR}.0) AS BIGINT) * {HOUR} AS bin, CAST(sum(late) AS BIGINT) AS late, CAST(sum(drops) AS BIGINT) AS drops FROM u GROUP BY 1) SELECT *, (bin - (SELECT min(bin) FROM b)) / 60000000.0::DOUBLE AS minutes FROM b")
def h1(d):
    a = d.arrival.select("timestamps", F.col("late_requests").alias("late"), F.col("queue_drops").alias("drops"))
    return X.align_series([a, d.process.select("timestamps", F.col("infer_batch_size").alias("late"))], "timestamps", ["late", "drops"], width=HOUR)


def _bucket_sql(source: str, key: str, at: str, value: str, n: int, w: int, more: str | None = None) -> str:
    """Buckets of ``value`` as x and xs (smoothed), and of ``more`` as m and ms."""
    m = [f", {more} AS m", ", avg(m) AS m", f", avg(m) OVER (PARTITION BY k ORDER BY bucket ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS ms"] if more else [""] * 3
    return f"e AS (SELECT {key}, min({at}) AS low, max({at}) AS high FROM {source} GROUP BY 1), i AS (SELECT s.{key} AS k, {at} AS t, {value} AS x{m[0]}, CASE WHEN high = low THEN {-(-n // 2) - 1} ELSE greatest(0, ceil(({at} - low) / ((high - low) / {n}.0::DOUBLE)) - 1) END::BIGINT AS bucket FROM {source} s JOIN e USING ({key})), p AS (SELECT k, bucket, min(t) AS first, avg(x) AS x{m[1]} FROM i GROUP BY ALL), sm AS (SELECT *, avg(x) OVER (PARTITION BY k ORDER BY bucket ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS xs{m[2]} FROM p)"


@query("h2_bucket_and_average", f"WITH {_bucket_sql('sink_log', 'system', 'arrival_us', 'latency_us', 100, 5)} SELECT k AS system, bucket, first, round(x, 6) AS latency_us, round(xs, 6) AS smooth FROM sm")
def h2(d):
    out = X.bucket_smooth(d.sink_log, ["system"], "arrival_us", ["latency_us"], 100, 5)
    return out.select("system", "bucket", "first", F.round("latency_us", 6).alias("latency_us"), F.round("latency_us_smooth", 6).alias("smooth"))


@query("h3_arrival_totals", f"WITH {_bucket_sql('arrival', 'stream', 'timestamps', 'late_requests', 50, 3, 'queue_drops')}, t AS (SELECT stream, CAST(sum(late_requests) AS BIGINT) AS total, CAST(sum(queue_drops) AS BIGINT) AS total_drops FROM arrival GROUP BY 1) SELECT k AS stream, bucket, round(xs, 6) AS late, round(ms, 6) AS drops, total, total_drops FROM sm JOIN t ON k = stream")
def h3(d):
    totals = d.arrival.groupBy("stream").agg(F.sum("late_requests").alias("total"), F.sum("queue_drops").alias("total_drops"))
    out = X.bucket_smooth(d.arrival, ["stream"], "timestamps", ["late_requests", "queue_drops"], 50, 3).join(totals, "stream")
    return out.select("stream", "bucket", F.round("late_requests_smooth", 6).alias("late"), F.round("queue_drops_smooth", 6).alias("drops"), "total", "total_drops")


@query("h4_average_memory", "SELECT system, round(avg(gpu_0_mem_usage + gpu_1_mem_usage) * 3, 6) AS gpu_mem, round(avg(mem_usage) * 3, 6) AS host_mem FROM hw WHERE gpu_0_mem_usage <> 0 OR gpu_1_mem_usage <> 0 GROUP BY system")
def h4(d):
    active = d.hw.where(F.greatest("gpu_0_mem_usage", "gpu_1_mem_usage") != 0)
    return active.groupBy("system").agg(F.round(F.avg(F.col("gpu_0_mem_usage") + F.col("gpu_1_mem_usage")) * 3, 6).alias("gpu_mem"), F.round(F.avg("mem_usage") * 3, 6).alias("host_mem"))


@query("h5_edge_power", "SELECT system, round(avg(power), 6) AS power FROM hw WHERE power > 0 GROUP BY system")
def h5(d):
    return d.hw.where("power > 0").groupBy("system").agg(F.round(F.avg("power"), 6).alias("power"))


@query("h5_full_edge_power", "SELECT system, l_orderkey, l_linenumber, timestamps, power FROM hw WHERE power > 0")
def h5_full(d):
    return d.hw.where("power > 0").select("system", "l_orderkey", "l_linenumber", "timestamps", "power")


@query("h6_memory_series", f"WITH {_bucket_sql('hw', 'system', 'timestamps', 'mem_usage', 100, 10)}, m AS (SELECT system, avg(mem_usage) AS mean FROM hw GROUP BY 1) SELECT k AS system, bucket, round(xs, 6) AS mem, round(mean, 6) AS mean FROM sm JOIN m ON k = system")
def h6(d):
    mean = d.hw.groupBy("system").agg(F.avg("mem_usage").alias("mean"))
    out = X.bucket_smooth(d.hw, ["system"], "timestamps", ["mem_usage"], 100, 10).join(mean, "system")
    return out.select("system", "bucket", F.round("mem_usage_smooth", 6).alias("mem"), F.round("mean", 6).alias("mean"))


@query("h7_batch_study", "WITH s AS (SELECT infer_batch_size, stream, min(t0) AS a, max(t11) AS b, avg(t11 - t0) AS took, count(*) AS n FROM request GROUP BY ALL) SELECT infer_batch_size, round(sum(n) / ((max(b) - min(a)) / 1000000.0::DOUBLE), 9) AS throughput, round(median(took), 6) AS took, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1")
def h7(d):
    per = d.request.groupBy("infer_batch_size", "stream").agg(F.min("t0").alias("a"), F.max("t11").alias("b"), F.avg(F.col("t11") - F.col("t0")).alias("took"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("infer_batch_size").agg(F.round(F.sum("n") / ((F.max("b") - F.min("a")) / 1e6), 9).alias("throughput"), F.round(F.median("took"), 6).alias("took"), F.sum("n").alias("n"))


@query("h7_stream_counts", "SELECT infer_batch_size, stream, count(*) AS n, min(t0) AS first, max(t11) AS last, round(avg(t11 - t0), 6) AS took FROM request GROUP BY ALL")
def h7_streams(d):
    took = F.round(F.avg(F.col("t11") - F.col("t0")), 6).alias("took")
    return d.request.groupBy("infer_batch_size", "stream").agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("first"), F.max("t11").alias("last"), took)


STAGES = {"prep": (4, 5), "batch": (5, 6), "wait": (6, 7), "infer": (7, 8), "decode": (8, 9), "crop": (9, 10)}


@query("h8_stage_breakdown", "WITH s AS (SELECT stream, infer_batch_size, " + ", ".join(f"avg(t{b} - t{a}) AS {n}" for n, (a, b) in STAGES.items()) + " FROM request GROUP BY ALL) SELECT stream, infer_batch_size, " + ", ".join(f"round({n}, 6) AS {n}" for n in STAGES) + ", CAST(round(avg(infer) OVER (PARTITION BY stream)) AS BIGINT) AS stream_infer FROM s")
def h8(d):
    per = d.request.groupBy("stream", "infer_batch_size").agg(*[F.avg(F.col(f"t{b}") - F.col(f"t{a}")).alias(n) for n, (a, b) in STAGES.items()])
    whole = per.groupBy("stream").agg(F.round(F.avg("infer")).cast("long").alias("stream_infer"))
    return per.join(whole, "stream").select("stream", "infer_batch_size", *[F.round(n, 6).alias(n) for n in STAGES], "stream_infer")


@query("h9_combined_experiment", "SELECT system, count(*) AS n_objects, count(*) / 1800.0::DOUBLE AS throughput, count(*) FILTER (latency_us < 20000 + CASE WHEN class = 'people' THEN 100000 ELSE 0 END) / 1800.0::DOUBLE AS goodput, round(avg(latency_us) / 1000, 6) AS latency_ms, least(count(*) / 4000.0::DOUBLE * 100, 100) / 1800 AS max_throughput FROM sink_log GROUP BY system")
def h9(d):
    expected = d.sink_log.select("system").distinct().withColumn("expected", F.lit(4000))
    out = X.combined(d.sink_log, expected, F.lit(1800), target_us=20_000)
    return out.withColumn("latency_ms", F.round("latency_ms", 6))


EXP = "ex AS (SELECT pipeline, 'people' AS class, CASE WHEN pipeline = 'traffic' THEN 0.25::DOUBLE ELSE 1.25::DOUBLE END * sum(people) AS expected FROM ct GROUP BY pipeline UNION ALL SELECT pipeline, 'cars', CASE WHEN pipeline = 'traffic' THEN sum(cars) * 1.0::DOUBLE ELSE 0 END FROM ct GROUP BY pipeline)"
CT = "ct AS (SELECT pipeline, system, count(*) FILTER (class = 'people') AS people, count(*) FILTER (class = 'cars') AS cars FROM sink_log GROUP BY ALL)"


def _expected(d):
    counts = d.sink_log.groupBy("pipeline", "system").agg(F.count_if(F.col("class") == "people").alias("people"), F.count_if(F.col("class") == "cars").alias("cars"))
    return X.expected_totals(counts, F.lit(False))


SPLIT = f"""WITH {CT}, {EXP}, w AS (SELECT pipeline, max(expected) FILTER (class = 'cars') AS ec, max(expected) FILTER (class = 'people') AS ep FROM ex GROUP BY 1),
g AS (SELECT *, pipeline = 'people' AS pp, latency_us < CASE WHEN pipeline = 'people' THEN 300000 ELSE 200000 END AS ok, CASE WHEN pipeline = 'people' AND class = 'cars' THEN 0 ELSE latency_us / 1000.0::DOUBLE END AS ms FROM sink_log),
n AS (SELECT system, pipeline, any_value(pp) AS pp, count(*) FILTER (class = 'cars') AS nc, count(*) FILTER (class <> 'cars') AS np, count(*) FILTER (ok AND class = 'cars') AS gc, count(*) FILTER (ok AND class <> 'cars') AS gp, avg(ms) FILTER (class = 'cars') AS lc, avg(ms) FILTER (class <> 'cars') AS lp, avg(ms) AS lt FROM g GROUP BY ALL),
r AS (SELECT system, pipeline, 'cars' AS class, CASE WHEN pp THEN 0 ELSE 100.0::DOUBLE * nc / ec END AS a, CASE WHEN pp THEN 0 ELSE 100.0::DOUBLE * gc / ec END AS i, CASE WHEN pp THEN 0 ELSE nc END AS t, CASE WHEN pp THEN 0 ELSE gc END AS g, lc AS l FROM n JOIN w USING (pipeline)
UNION ALL SELECT system, pipeline, 'people', 100.0::DOUBLE * np / ep, 100.0::DOUBLE * gp / ep, np, gp, lp FROM n JOIN w USING (pipeline)
UNION ALL SELECT system, pipeline, 'total', 100.0::DOUBLE * (nc + np) / CASE WHEN pp THEN ep ELSE ec + ep END, 100.0::DOUBLE * (gc + gp) / CASE WHEN pp THEN ep ELSE ec + ep END, np + CASE WHEN pp THEN 0 ELSE nc END, gp + CASE WHEN pp THEN 0 ELSE gc END, lt FROM n JOIN w USING (pipeline))
SELECT system, pipeline, class, round(least(100, a), 6) AS arrived, round(least(100, i), 6) AS in_time, round(t / 1800.0::DOUBLE, 9) AS throughput, round(g / 1800.0::DOUBLE, 9) AS goodput, round(l, 6) AS latency_ms FROM r"""


@query("h10_split_experiment", SPLIT)
def h10(d):
    out = X.split(d.sink_log, _expected(d), seconds=1800)
    return out.select("system", "pipeline", "class", *[F.round(c, 6).alias(c) for c in ("arrived", "in_time", "latency_ms")], *[F.round(c, 9).alias(c) for c in ("throughput", "goodput")])


@query("h11_expected_totals", f"WITH {CT}, {EXP} SELECT * FROM ex")
def h11(d):
    return _expected(d)


@query("h12_run_bounds", "SELECT system, pipeline, min(arrival_us) AS first, max(arrival_us) AS last FROM sink_log GROUP BY ALL")
def h12(d):
    return d.sink_log.groupBy("system", "pipeline").agg(F.min("arrival_us").alias("first"), F.max("arrival_us").alias("last"))


@query("h13_box_plot", "WITH q AS (SELECT system, quantile_cont(latency_us, 0.25) AS q1, quantile_cont(latency_us, 0.5) AS med, quantile_cont(latency_us, 0.75) AS q3 FROM sink_log GROUP BY 1) SELECT system, q1, med AS median, q3, min(latency_us) FILTER (latency_us >= q1 - 1.5 * (q3 - q1)) AS low, max(latency_us) FILTER (latency_us <= q3 + 1.5 * (q3 - q1)) AS high FROM sink_log JOIN q USING (system) GROUP BY ALL")
def h13(d):
    return X.box_plot(d.sink_log, ["system"], "latency_us")


SER = f"sr AS (SELECT system, {BIN} AS bin, count(*) AS n, avg(latency_us) AS latency_us, count(*) FILTER (latency_us < 250000) / count(*)::DOUBLE AS goodput_ratio FROM sink_log GROUP BY ALL)"


def _series(d):
    return X.second_series(d.sink_log, ["system"], width=HOUR)


@query("h14_overall_series", f"WITH {SER}, {_bucket_sql('sr', 'system', 'bin', 'n', 780, 3, 'latency_us')}, a AS (SELECT k, avg(xs) AS mean FROM sm GROUP BY k), r AS (SELECT system, count(*) FILTER (latency_us < 250000) / count(*)::DOUBLE AS ratio FROM sink_log GROUP BY 1) SELECT sm.k AS system, bucket, first, round(xs, 6) AS throughput, round(ms, 4) AS latency_us, round(mean, 6) AS avg_throughput, round(mean * ratio, 6) AS avg_goodput FROM sm JOIN a ON a.k = sm.k JOIN r ON r.system = sm.k")
def h14(d):
    out = X.overall_series(d.sink_log, ["system"], width=HOUR)
    return out.withColumns({c: F.round(c, 4 if c == "latency_us" else 6) for c in ("throughput", "latency_us", "avg_throughput", "avg_goodput")})


@query("h15_prepared_series", f"WITH sl AS (SELECT * FROM sink_log WHERE latency_us < 200000), {SER.replace('FROM sink_log', 'FROM sl')}, b AS (SELECT system, bin, (n + 1000000.0::DOUBLE / greatest(latency_us, 1) * n) / 2 AS throughput FROM sr), {_bucket_sql('b', 'system', 'bin', 'throughput', 180, 3)}, t AS (SELECT k AS system, (first - min(first) OVER (PARTITION BY k)) / 60000000.0::DOUBLE AS minutes, xs AS throughput FROM sm), z AS (SELECT system, unnest(range(1, CAST(greatest(0, ceil(45000 - max(minutes))) AS BIGINT) + 1)) AS i FROM t GROUP BY system) SELECT system, minutes, round(throughput, 4) AS throughput FROM t UNION ALL SELECT system, CAST(-i AS DOUBLE), 0.0::DOUBLE FROM z")
def h15(d):
    return X.prepared_series(d.sink_log, ["system"], width=HOUR, upto=45_000).withColumn("throughput", F.round("throughput", 4))


@query("h16_warm_start_series", f"WITH {SER}, b AS (SELECT system AS k2, bin, (n + 1000000.0 / greatest(latency_us, 1) * n) / 2 AS throughput FROM sr WHERE latency_us < 250000), {_bucket_sql('b', 'k2', 'bin', 'throughput', 180, 5)} SELECT k AS system, bucket, round(xs, 4) AS throughput FROM sm")
def h16(d):
    s = X.blended(_series(d).where("latency_us < 250000"))
    out = X.bucket_smooth(s, ["system"], "bin", ["throughput"], 180, 5)
    return out.select("system", "bucket", F.round("throughput_smooth", 4).alias("throughput"))


@query("h17_pipeline_series", f"WITH ps AS (SELECT pipeline, {BIN} AS bin, count(*) AS n FROM sink_log GROUP BY ALL), {_bucket_sql('ps', 'pipeline', 'bin', 'n', 780, 3)} SELECT k AS pipeline, bucket, first, round(xs, 6) AS throughput FROM sm")
def h17(d):
    out = X.bucket_smooth(X.second_series(d.sink_log, ["pipeline"], width=HOUR), ["pipeline"], "bin", ["n"], 780, 3)
    return out.select("pipeline", "bucket", "first", F.round("n_smooth", 6).alias("throughput"))


@query("h18_workload_achieved", f"WITH w AS (SELECT CAST(user_id % 2 AS BIGINT) AS k, tm, sum(n)::DOUBLE AS workload FROM (SELECT user_id, CAST(floor(t0 / {HOUR}.0) AS BIGINT) * {HOUR} AS tm, 1 AS n FROM request) GROUP BY ALL), t AS (SELECT k, tm, workload * 0.9::DOUBLE AS throughput FROM w WHERE tm % {7 * HOUR} = 0), b AS (SELECT w.k AS k, w.tm AS tm, workload, t.throughput AS v0, t.tm AS a0 FROM w ASOF LEFT JOIN t ON w.k = t.k AND w.tm >= t.tm), c AS (SELECT w.k AS k, w.tm AS tm, t.throughput AS v1, t.tm AS a1 FROM w ASOF LEFT JOIN t ON w.k = t.k AND w.tm <= t.tm), j AS (SELECT k, workload, CASE WHEN a0 IS NOT NULL AND (a1 IS NULL OR tm - a0 <= a1 - tm) THEN v0 ELSE v1 END AS throughput FROM b JOIN c USING (k, tm)) SELECT k, round(sum(greatest(0, workload - throughput)), 6) AS missed, round(sum(greatest(workload, throughput)), 6) AS workload FROM j GROUP BY k")
def h18(d):
    w = d.request.groupBy((F.col("user_id") % 2).alias("k"), (F.floor(F.col("t0") / HOUR) * HOUR).alias("tm")).agg(F.count(F.lit(1)).cast("double").alias("workload"))
    t = w.where(F.col("tm") % (7 * HOUR) == 0).select("k", "tm", (F.col("workload") * 0.9).alias("throughput"))
    out = X.missed(J.nearest(w, t, ["k"], "tm", "throughput", 100 * HOUR), ["k"])
    return out.select("k", F.round("missed", 6).alias("missed"), F.round("workload", 6).alias("workload"))


@query("h19_gap_fill", f"WITH s AS (SELECT system, (bin - min(bin) OVER ()) / 60000000.0::DOUBLE AS minutes, n FROM (SELECT system, {BIN} AS bin, count(*) AS n FROM sink_log GROUP BY ALL)), g AS (SELECT *, lead(minutes) OVER (PARTITION BY system ORDER BY minutes) AS nx FROM s) SELECT system, minutes, n FROM s UNION ALL SELECT system, minutes + 61, 0 FROM g WHERE nx - minutes > 61")
def h19(d):
    s = _series(d)
    s = s.crossJoin(F.broadcast(s.agg(F.min("bin").alias("first_")))).withColumn("minutes", (F.col("bin") - F.col("first_")) / 60e6)  # one row
    return X.fill_gaps(s, ["system"], "minutes", ["n"], 61.0)


COUNTS = "oc AS (SELECT x1 % 2 AS cam, image_id AS frame, count(*) FILTER (class_id = 0) AS person, count(*) FILTER (class_id = 2) AS car FROM detections GROUP BY ALL)"


def _counts(d):
    return d.detections.groupBy((F.col("x1") % 2).alias("cam"), F.col("image_id").alias("frame")).agg(F.count_if(F.col("class_id") == 0).alias("person"), F.count_if(F.col("class_id") == 2).alias("car"))


@query("h20_workload_series", f"WITH {COUNTS}, b AS (SELECT cam, CAST(floor(frame / 300.0) AS BIGINT) AS bucket, sum(CASE WHEN cam = 0 THEN person // 2 ELSE person END + car) AS s FROM oc GROUP BY ALL), e AS (SELECT cam, max(frame) AS last FROM oc GROUP BY 1) SELECT cam, bucket, s / 10.0::DOUBLE AS workload FROM b JOIN e USING (cam) WHERE (bucket + 1) * 300 <= last + 1")
def h20(d):
    return X.workload(_counts(d), ["cam"], 300, F.col("cam") == 0)


@query("h21_bucket_extremes", f"WITH {COUNTS} SELECT cam, CAST(floor(frame / 300.0) AS BIGINT) AS bucket, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, min({c}) AS {c}_low, max({c}) AS {c}_high" for c in ("person", "car")) + " FROM oc GROUP BY ALL")
def h21(d):
    six = [f.alias(f"{c}_{n}") for c in ("person", "car") for n, f in (("mean", F.round(F.avg(c), 6)), ("low", F.min(c)), ("high", F.max(c)))]
    return _counts(d).groupBy("cam", F.floor(F.col("frame") / 300).alias("bucket")).agg(*six)


@query("h22_moving_average", "SELECT event_id, round(a, 6) AS average FROM (SELECT event_id, row_number() OVER w AS rn, avg(v) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a FROM request WINDOW w AS (PARTITION BY user_id ORDER BY t0, event_id)) WHERE rn >= 10")
def h22(d):
    return X.moving_average(d.request, ["user_id"], ["t0", "event_id"], "v", 10).select("event_id", F.round("average", 6).alias("average"))


TAIL = """WITH RECURSIVE o AS (SELECT user_id, list(v ORDER BY t0, event_id) AS a FROM request GROUP BY user_id HAVING count(*) >= 5),
t(user_id, i, a, avs) AS (SELECT user_id, 0, a, list_transform(range(greatest(len(a) - 14, 0), len(a) - 4), lambda j: list_avg(a[j + 1 : j + 5])) FROM o
UNION ALL SELECT user_id, i + 1, a, list_append(avs, (list_avg(a[len(a) - (5 - i) + 1 :]) + list_sum(avs[greatest(len(avs) - 9, 1) :])) / (least(len(avs), 10) + 1)) FROM t WHERE i < 4)
SELECT user_id, CAST(i AS BIGINT) AS i, round(avs[len(avs)], 6) AS average FROM t WHERE i > 0"""


@query("h22_average_tail", TAIL)
def h22_tail(d):
    return X.average_tail(d.request, ["user_id"], ["t0", "event_id"], "v", 5).withColumn("average", F.round("average", 6))


@query("h23_bandwidth_mean", "WITH s AS (SELECT trace, mbps, row_number() OVER (PARTITION BY trace ORDER BY tm) AS i FROM bandwidth) SELECT CAST(i AS BIGINT) AS i, round(avg(mbps), 2) AS mean FROM s GROUP BY i")
def h23(d):
    return J.mean_by_position(d.bandwidth, "trace", ["tm"], "mbps", of_all=False).select(F.col("i").cast("long").alias("i"), "mean")


@query("h24_success_rate", "SELECT system, count(*) / 4000.0::DOUBLE * 100 AS throughput_pct, count(*) FILTER (latency_us < 200000) / 4000.0::DOUBLE * 100 AS goodput_pct FROM sink_log GROUP BY 1")
def h24(d):
    per = d.sink_log.groupBy("system").agg(F.count(F.lit(1)).alias("throughput"), F.count_if(F.col("latency_us") < 200_000).alias("goodput")).withColumn("most", F.lit(4000))
    return X.success_rate(per).select("system", "throughput_pct", "goodput_pct")


@query("h25_reduced_slo", "WITH s AS (SELECT system, pipeline, slo, CAST(floor(count(*) / 7.0) AS BIGINT) AS thr, CAST(floor(count(*) FILTER (latency_us < slo) / 7.0) AS BIGINT) AS good FROM sink_log, (VALUES (100000), (200000)) AS v(slo) GROUP BY ALL) SELECT slo::BIGINT AS slo, system, CAST(sum(thr) AS BIGINT) AS throughput, CAST(sum(good) AS BIGINT) AS goodput FROM s GROUP BY ALL")
def h25(d):
    rows = d.sink_log.withColumn("slo", F.explode(F.array(*[F.lit(x).cast("long") for x in (100_000, 200_000)])))
    per = rows.groupBy("system", "pipeline", "slo").agg(F.floor(F.count(F.lit(1)) / 7).alias("thr"), F.floor(F.count_if(F.col("latency_us") < F.col("slo")) / 7).alias("good"))
    return per.groupBy("slo", "system").agg(F.sum("thr").alias("throughput"), F.sum("good").alias("goodput"))


@query("h26_memory_overhead", "WITH m AS (SELECT system, avg(mem_usage) AS mem FROM hw GROUP BY 1) SELECT system, round(mem - (SELECT mem FROM m WHERE system = 'A'), 6) AS overhead FROM m")
def h26(d):
    m = d.hw.groupBy("system").agg(F.avg("mem_usage").alias("mem"))
    return m.crossJoin(F.broadcast(m.where("system = 'A'").select(F.col("mem").alias("base_")))).select("system", F.round(F.col("mem") - F.col("base_"), 6).alias("overhead"))  # one row


@query("h27_power_difference", "WITH s AS (SELECT system, l_linenumber, power, row_number() OVER (PARTITION BY system, l_linenumber ORDER BY timestamps, l_orderkey, power) AS i FROM hw) SELECT a.l_linenumber, CAST(a.i AS BIGINT) AS i, a.power - b.power AS difference FROM s a JOIN s b ON a.i = b.i AND a.l_linenumber = b.l_linenumber WHERE a.system = 'N' AND b.system = 'A'")
def h27(d):
    one = lambda s: d.hw.where(F.col("system") == s)
    out = J.positional_difference(one("N"), one("A"), ["l_linenumber"], ["timestamps", "l_orderkey", "power"], "power")
    return out.select("l_linenumber", F.col("i").cast("long").alias("i"), "difference")


BOX = "SELECT metric, q1, med AS median, q3, min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) AS low, max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) AS high FROM {0} JOIN (SELECT metric, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM {0} GROUP BY 1) q USING (metric) GROUP BY ALL".format


@query("h28_federated_latency", f"WITH fl AS (SELECT 'fine_tune' AS metric, (t8 - t4) / 1000000.0::DOUBLE AS x FROM request WHERE event_type = 'signup' UNION ALL SELECT 'round_trip', (t11 - t0) / 1000000.0::DOUBLE FROM request WHERE event_type = 'signup') SELECT metric, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, round(low, 9) AS low, round(high, 9) AS high FROM ({BOX('fl')})")
def h28(d):
    """Rows of one kind of the decision log, which holds all requests: sign-ups stand for federated aggregations, with the times of fine-tuning and of the round trip."""
    kind = F.when(F.col("event_type") == "signup", "federatedAggregation").otherwise("step")
    path = scratch(d.spark, "federated")
    d.request.select(F.concat_ws(",", kind, F.col("t8") - F.col("t4"), F.col("t11") - F.col("t0"), F.lit("0"), F.lit("0"), F.col("v") / 100, F.lit("0")).alias("value")).write.text(path)
    rows = R.rl_log(d.spark, path, kind="federatedAggregation")
    rows = rows.select((F.col("us") / 1e6).alias("fine_tune"), (F.col("round_us") / 1e6).alias("round_trip")).unpivot([], ["fine_tune", "round_trip"], "metric", "x")
    return X.box_plot(rows, ["metric"], "x").select("metric", *[F.round(c, 9).alias(c) for c in ("q1", "median", "q3", "low", "high")])


@query("h29_parameter_surface", "WITH x AS (SELECT DISTINCT prep % 5 AS x FROM model_profile), y AS (SELECT DISTINCT cpu % 7 AS y FROM model_profile), g AS (SELECT prep % 5 AS x, cpu % 7 AS y, sum(infer) AS v FROM model_profile GROUP BY ALL) SELECT x, y, CAST(coalesce(v, 0) AS BIGINT) AS v FROM x CROSS JOIN y LEFT JOIN g USING (x, y)")
def h29(d):
    rows = d.model_profile.select((F.col("prep") % 5).alias("x"), (F.col("cpu") % 7).alias("y"), F.col("infer").alias("v"))
    return J.full_grid(rows, "x", "y", "v")


@query("h30_parameter_pairs", "WITH r AS (SELECT prep % 3 AS a, cpu % 3 AS b, mem % 3 AS c, post % 3 AS d, infer FROM model_profile) SELECT a, b, c, d, round(avg(infer), 6) AS mean FROM r GROUP BY GROUPING SETS ((a, b), (a, c), (a, d), (b, c), (b, d), (c, d))")
def h30(d):
    c = F.col
    rows = d.model_profile.select((c("prep") % 3).alias("a"), (c("cpu") % 3).alias("b"), (c("mem") % 3).alias("c"), (c("post") % 3).alias("d"), "infer")
    pairs = [[c("a"), c("b")], [c("a"), c("c")], [c("a"), c("d")], [c("b"), c("c")], [c("b"), c("d")], [c("c"), c("d")]]
    return rows.groupingSets(pairs, c("a"), c("b"), c("c"), c("d")).agg(F.round(F.avg("infer"), 6).alias("mean"))


@query("h31_ranked_runs", "WITH r AS (SELECT model, sum(infer) AS thr FROM model_profile GROUP BY 1) SELECT model, CAST(thr AS BIGINT) AS throughput, CAST(rank() OVER (ORDER BY thr DESC) AS BIGINT) AS place, round((thr - min(thr) OVER ()) / (max(thr) OVER () - min(thr) OVER ())::DOUBLE, 6) AS colour FROM r")
def h31(d):
    runs = d.model_profile.groupBy("model").agg(F.sum("infer").alias("throughput"))
    ends = runs.agg(F.min("throughput").alias("low_"), F.max("throughput").alias("high_"))
    place = F.rank().over(Window.orderBy(F.desc("throughput"))).cast("long")  # one row per run
    return runs.crossJoin(F.broadcast(ends)).select("model", "throughput", place.alias("place"), F.round((F.col("throughput") - F.col("low_")) / (F.col("high_") - F.col("low_")), 6).alias("colour"))


@query("h32_learning_curve", "WITH i AS (SELECT agent, episode, step, reward, (value - reward) ** 2 AS loss, row_number() OVER (PARTITION BY agent, episode ORDER BY tm, step) AS pos FROM trajectory), n AS (SELECT agent, count(DISTINCT episode) AS runs FROM trajectory GROUP BY 1), a AS (SELECT agent, pos, sum(reward) / any_value(runs) AS reward, sum(loss) / any_value(runs) AS loss FROM i JOIN n USING (agent) GROUP BY ALL) SELECT CAST(pos AS BIGINT) AS pos, round(sum(reward) / (SELECT count(*) FROM n), 9) AS reward, round(sum(loss) / (SELECT count(*) FROM n), 9) AS loss FROM a GROUP BY pos")
def h32(d):
    steps = d.trajectory.withColumn("loss", F.pow(F.col("value") - F.col("reward"), 2))
    out = X.learning_curve(steps, "agent", "episode", ["tm", "step"], ["reward", "loss"])
    return out.select("pos", F.round("reward", 9).alias("reward"), F.round("loss", 9).alias("loss"))


@query("h33_metrics_report", "WITH m AS (SELECT system, count(*)::DOUBLE AS n, avg(latency_us) AS mean FROM sink_log GROUP BY 1) SELECT system, 'n' AS metric, n AS value FROM m UNION ALL SELECT system, 'mean', round(mean, 6) FROM m")
def h33(d):
    m = d.sink_log.groupBy("system").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("latency_us"), 6).alias("mean"))
    return m.unpivot("system", ["n", "mean"], "metric", "value")


@query("h34_run_length", "SELECT DISTINCT stream, CASE stream WHEN 'stream1' THEN 2160 WHEN 'stream2' THEN 7200 ELSE 1800 END::BIGINT AS seconds FROM request")
def h34(d):
    name = F.when(F.col("stream") == "stream1", "fcty-1").when(F.col("stream") == "stream2", "camp-1").otherwise("full")
    return d.request.select("stream", X.run_seconds(name).alias("seconds")).distinct()
