"""Keyed state over several micro-batches: quiet keys, rows out of order, bounded buffers."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riverglass.operators import batching as G
from riverglass.operators import rollup as R
from riverglass.session import scratch
from riverglass.streaming import live as L

SCHEMA = "k string, t long, id long, v long"


def arrivals(spark, parts):
    """A stream that gives ``parts`` (lists of rows) one micro-batch each."""
    path = scratch(spark, "arrivals")
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def results(spark, stream, mode):
    path = scratch(spark, "results")
    L.run_available(stream, f"{path}/out", f"{path}/state", mode)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{fields}, batch_id long").parquet(f"{path}/out")


def test_a_quiet_key_loses_its_batch_by_timer(spark):
    s = 1_000_000
    parts = [[("quiet", 1 * s, 1, 0), ("quiet", 2 * s, 2, 0), ("busy", 1 * s, 3, 0)], [("busy", 30 * s, 4, 0), ("busy", 12 * s, 5, 0)], [("busy", 300 * s, 6, 0)], [("busy", 301 * s, 7, 0)]]
    out = L.timed_batches(L.with_event_time(arrivals(spark, parts), "t", "20 seconds"), "k", "t", "id", 3, 10 * s)
    got = {tuple(r)[:5]: r.batch_id for r in results(spark, out, "append").select("k", "start", "n", "closed_us", "timed_out", "batch_id").collect()}
    want = {("quiet", 1 * s, 2, 11 * s, True), ("busy", 1 * s, 1, 11 * s, True), ("busy", 12 * s, 1, 22 * s, True), ("busy", 30 * s, 1, 40 * s, True)}
    assert set(got) == want  # what waits at 300 s is open still
    assert got["quiet", 1 * s, 2, 11 * s, True] > 1  # told when the watermark passed it, though the key had no rows then


def test_timed_batches_match_batch_mode_out_of_order(spark):
    rows = [(f"k{i % 3}", (1 + i * 37 % 1000) * 100_000 + i, i, 0) for i in range(600)]
    order = sorted(rows, key=lambda r: r[1] + (r[2] % 5) * 8_000_000)  # rows up to 32 s late
    parts = [order[i : i + 150] for i in range(0, 600, 150)] + [[("end", 10**10, 0, 0)]]
    out = L.timed_batches(L.with_event_time(arrivals(spark, parts), "t", "60 seconds"), "k", "t", "id", 4, 1_500_000)
    got = {(r.k, r.start): r.n for r in results(spark, out, "append").collect()}
    batches = G.timed_batches(spark.createDataFrame(rows, SCHEMA), ["k"], "t", "id", 4, 1_500_000)
    want = {(r.k, r.start): r.n for r in batches.groupBy("k", "batch").agg(F.min("t").alias("start"), F.count("*").alias("n")).collect()}
    assert got == want and any(n < 4 for n in want.values()) and 4 in want.values()


def test_keys_of_a_bucket_share_state(spark):
    rows = [(None if i % 9 == 0 else 2**60 + i % 9, 1 + i * 1_000_000, i) for i in range(90)]
    path = scratch(spark, "arrivals")
    for part in (rows[:45], rows[45:], [(None, 10**10, 99)]):
        spark.createDataFrame(part, "k long, t long, id long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k long, t long, id long").option("maxFilesPerTrigger", 1).parquet(path)
    out = L.timed_batches(L.with_event_time(stream, "t", "60 seconds"), "k", "t", "id", 4, 10**9, buckets=2)
    assert "bucket_" in out._jdf.queryExecution().analyzed().toString()
    got = sorted(((r.k or 0), r.start, r.n, r.timed_out) for r in results(spark, out, "append").collect())
    ends = [(k, (4 * b * 9 + k) * 1_000_000 + 1, 4 if b < 2 else 2, b == 2) for k in range(9) for b in range(3)]
    assert got == sorted((2**60 + k if k else 0, start, n, late) for k, start, n, late in ends)


def test_second_records_match_batch_mode(spark):
    rows = [(f"k{i % 2}", 1 + i * 130_000 + (i % 7) * 20_000, i, 0) for i in range(300)]
    order = sorted(rows, key=lambda r: (r[1] // 10_000_000, -r[1]))
    parts = [order[i : i + 100] for i in range(0, 300, 100)] + [[("end", 10**9, 0, 0)]]
    out = L.second_records(L.with_event_time(arrivals(spark, parts), "t", "30 seconds"), ["k"], "t", "id")
    pick = lambda df, second: sorted((r[0], r[1], r.n, round(r.mean, 6), round(r.variance, 3)) for r in df.select("k", second, "n", "mean", "variance").collect())
    got = pick(results(spark, out, "append"), F.floor(F.unix_micros("w.start") / 1_000_000))
    assert got == pick(R.per_second(spark.createDataFrame(rows, SCHEMA), ["k"], "t", "id"), "second")


def test_throughput_keeps_only_the_longest_period(spark):
    rows = [("a", i * 700_000, i, 0) for i in range(200)] + [("b", 5, 1, 0)]
    parts = [rows[100:], rows[:50], rows[50:100]]  # old rows last
    out = results(spark, L.throughput(arrivals(spark, parts), "k", "t", periods=(1, 7, 60)), "update")
    names = ["thrput_1s", "thrput_7s", "thrput_60s"]
    got = {tuple(r) for r in L.latest_state(out, ["k"], names).collect()}
    assert got == {tuple(r) for r in R.throughput(spark.createDataFrame(rows, SCHEMA), ["k"], "t", periods=(1, 7, 60)).select("k", *names).collect()}


@pytest.mark.parametrize("size", [50, 1000])
def test_smoothed_holds_few_rows_of_a_micro_batch(spark, size):
    rows = [("a", (i * 7919) % 2000, i, (i * 31) % 97) for i in range(2000)]
    parts = [sorted(p, key=lambda r: r[2]) for i in range(0, 2000, size * 2) for p in [sorted(rows, key=lambda r: r[1])[i : i + size * 2]]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = L.latest_state(results(spark, L.smoothed(arrivals(spark, parts), "k", "t", "v"), "update"), ["k"], ["smoothed"]).first().smoothed
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    s = None
    for x in pd.DataFrame(rows, columns=["k", "t", "id", "v"]).sort_values("t").v.astype(float):
        s = x if s is None else (s * 0.2 + x * 0.8 if x > s else s * 0.8 + x * 0.2)
    assert abs(got - s) < 1e-9
