"""Streaming forms (section K): run over all files as a stream, they must give what the batch query gives.

K5 and K8 to K11 replay the events in five arrivals, part of them out of order, and a heartbeat; their twins know nothing of arrivals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import PERIODS
from ..operators import rollup as R
from ..streaming import live as L
from .batching_queries import TIMED_SQL, WAIT
from .registry import ORACLES, query
from .rollup_queries import COMB, SEC, SECOND
from .source_queries import scratch


def _results(d, stream: DataFrame, name: str, mode: str) -> DataFrame:
    path = scratch(d.spark, name)
    L.run_available(stream, f"{path}/out", f"{path}/state", mode)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", batch_id long"
    return d.spark.read.schema(schema).parquet(f"{path}/out")


def _live(d) -> L.LiveDomain:
    return L.LiveDomain(d.spark, d.folder)


def _replayed(d, at: str) -> DataFrame:
    """Requests of the replayed events, with the event time and watermark of column ``at``."""
    live, delay = L.replay(d.events, scratch(d.spark, "replay"))
    return L.with_event_time(live.request, at, delay)


@query("k1_stream_sink_report", "SELECT system, CAST(floor(arrival_us / 1000000.0) AS BIGINT) * 1000000 AS start_us, count(*) AS n, CAST(sum(latency_us) AS DOUBLE) / count(*) AS latency FROM sink_log GROUP BY ALL")
def k1(d):
    log = L.with_event_time(_live(d).sink_log, "arrival_us", "10 minutes")
    out = L.tumbling(log, ["system"], "1 second", F.count(F.lit(1)).alias("n"), (F.sum("latency_us") / F.count(F.lit(1))).alias("latency"))
    return L.latest_state(_results(d, out, "k1", "update"), ["system", "start_us"], ["n", "latency"])


@query("k2_stream_hw_report", "SELECT system, CAST(floor(timestamps / 15000000.0) AS BIGINT) * 15000000 AS start_us, max(cpu_usage) AS cpu, max(mem_usage) AS mem FROM hw GROUP BY ALL")
def k2(d):
    hw = L.with_event_time(_live(d).hw, "timestamps", "3650 days")
    out = L.tumbling(hw, ["system"], "15 seconds", F.max("cpu_usage").alias("cpu"), F.max("mem_usage").alias("mem"))
    return L.latest_state(_results(d, out, "k2", "update"), ["system", "start_us"], ["cpu", "mem"])


@query("k3_stream_late_requests", "SELECT stream, count(*) AS n, count(*) FILTER (t3 - t0 > slo - 50) AS late FROM request GROUP BY stream")
def k3(d):
    out = _live(d).request.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.count_if(R.late(d.request, 50)).alias("late"))
    return L.latest_state(_results(d, out, "k3", "update"), ["stream"], ["n", "late"])


@query("k4_stream_ewma", "SELECT stream, round(list_reduce(list(CAST(v AS DOUBLE) ORDER BY t0), lambda s, x: CASE WHEN x > s THEN 0.2 * s + 0.8 * x ELSE 0.8 * s + 0.2 * x END), 6) AS smoothed FROM request GROUP BY stream")
def k4(d):
    out = L.latest_state(_results(d, L.smoothed(_live(d).request, "stream", "t0", "v"), "k4", "update"), ["stream"], ["smoothed"])
    return out.select("stream", F.round("smoothed", 6).alias("smoothed"))


@query("k5_stream_timed_batches", f"WITH RECURSIVE {TIMED_SQL.removeprefix('WITH RECURSIVE ').replace('SELECT event_id, batch FROM b', '')} SELECT user_id, min(t0) AS start, count(*) AS n, CASE WHEN count(*) = 8 THEN max(t0) ELSE min(t0) + {WAIT} END AS closed_us, count(*) < 8 AS timed_out FROM b JOIN request USING (event_id, user_id) GROUP BY user_id, batch")
def k5(d):
    out = L.timed_batches(_replayed(d, "t0"), "user_id", "t0", "event_id", 8, WAIT)
    return _results(d, out, "k5", "append").select("user_id", "start", "n", "closed_us", "timed_out")


@query("k6_stream_sliding_rates", "SELECT stream, e AS end_us, count(*) AS n FROM (SELECT stream, unnest(range(CAST(floor(t0 / 60000000.0) AS BIGINT) * 60000000 + 60000000, CAST(floor(t0 / 60000000.0) AS BIGINT) * 60000000 + 240000000, 60000000)) AS e FROM request) GROUP BY ALL")
def k6(d):
    rows = L.with_event_time(_live(d).request, "t0", "10 minutes")
    out = L.sliding(rows, ["stream"], "3 minutes", "1 minute", F.count(F.lit(1)).alias("n"))
    return L.latest_state(_results(d, out, "k6", "update"), ["stream", "end_us"], ["n"])


@query("k7_stream_dedup", "SELECT DISTINCT user_id, day FROM request")
def k7(d):
    rows = L.with_event_time(_live(d).request, "t0", "30 days").withColumn("day", F.col("day"))
    return _results(d, rows.dropDuplicatesWithinWatermark(["user_id", "day"]).select("user_id", "day"), "k7", "append").select("user_id", "day")


@query("k8_stream_second_records", f"WITH {SEC} SELECT stream, sender_host, second, n, round(mean, 3) AS mean, round(sqrt(variance), 3) AS spread FROM sec")
def k8(d):
    out = L.second_records(_replayed(d, "t0"), ["stream", "sender_host"], second=SECOND)
    rows = _results(d, out, "k8", "append")
    second = F.floor(F.unix_micros("w.start") / SECOND).cast("long").alias("second")
    return rows.select("stream", "sender_host", second, "n", F.round("mean", 3).alias("mean"), F.round(F.sqrt("variance"), 3).alias("spread"))


def _period_sql(p: int) -> str:
    w = f"OVER (PARTITION BY stream ORDER BY second RANGE BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    m = f"(sum(n * mean) {w} / sum(n) {w})"
    rate = f"CAST(ceil(sum(n) {w} / {p}.0::DOUBLE) AS BIGINT) AS arrival_rate_{p}s"
    return f"{rate}, round(CASE WHEN {m} > 0 THEN sqrt(greatest(sum(n * (variance + mean * mean)) {w} / sum(n) {w} - {m} * {m}, 0)) / {m} ELSE 0 END, 5) AS coeff_var_{p}s"


@query("k9_stream_period_records", f"WITH {COMB} SELECT stream, second, {', '.join(map(_period_sql, PERIODS))} FROM comb")
def k9(d):
    seconds = L.second_records(_replayed(d, "t0"), ["stream", "sender_host"], second=SECOND)
    rows = _results(d, L.period_records(L.combined_records(seconds, ["stream"], SECOND), ["stream"], SECOND), "k9", "append")
    return rows.select("stream", "second", *[c for p in PERIODS for c in (f"arrival_rate_{p}s", F.round(f"coeff_var_{p}s", 5).alias(f"coeff_var_{p}s"))])


@query("k10_stream_throughput")
def k10(d):
    out = L.throughput(_replayed(d, "t11"), "stream", second=SECOND)
    names = [f"thrput_{p}s" for p in PERIODS]
    return L.latest_state(_results(d, out, "k10", "update"), ["stream"], names).where("stream IS NOT NULL")


@query("k11_stream_latest_metrics")
def k11(d):
    live, _ = L.replay(d.events, scratch(d.spark, "replay"))
    keys, values = ["stream", "sender_host"], ["v", "late_requests", "queue_drops"]
    out = L.latest_rows(live.arrival.withColumnRenamed("p95_queueing_duration_us", "v"), keys, ["timestamps", "event_id"], values)
    return L.latest_state(_results(d, out, "k11", "update"), keys, values).where("stream IS NOT NULL")


ORACLES |= {"k10_stream_throughput": ORACLES["c16_throughput"], "k11_stream_latest_metrics": ORACLES["c22_latest_metrics"]}
