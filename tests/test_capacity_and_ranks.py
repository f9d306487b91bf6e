"""Stage timing, queue chains, distributed row numbers, network profiles with fallbacks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riverglass.operators import batching as G
from riverglass.operators import capacity as C
from riverglass.operators import profiles as E
from riverglass.operators.ranks import numbered
from riverglass.session import clear, stored


def test_row_numbers_match_a_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(300), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, o long, i long")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.i: (r.n, r.all) for r in numbered(df, ["k"], ["o", "i"], "n", total="all").collect()}
        w = Window.partitionBy("k").orderBy("o", "i")
        want = {r.i: (r.n, r.all) for r in df.withColumns({"n": F.row_number().over(w), "all": F.count("*").over(Window.partitionBy("k"))}).collect()}
        plan = numbered(df, ["k"], ["o", "i"], "n")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want
    assert "row_number()" in plan and "part_" in plan
    assert numbered(df.limit(0), ["k"], ["o"], "n").count() == 0


def test_stored_tables_can_be_cleared(spark):
    df = stored(spark.range(3), "gone")
    files = df.inputFiles()
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path)
    clear(spark)
    assert not fs.exists(path)


def test_warm_up_drops_whole_batches(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 2)
    assert G.after_warm_up(df, ["k"], ["id"], 8, configured=2).count() == 500 - 2 * 16 * 8
    assert G.after_warm_up(df, ["k"], ["id"], 8, configured=20).count() == 500 - 2 * 20 * 8


def graph(spark, edges, nodes):
    schema = "pipeline string, node string, device string, max_proc double, transfer double, queue double"
    return spark.createDataFrame([("p", *n) for n in nodes], schema), spark.createDataFrame([("p", *e) for e in edges], "pipeline string, src string, dst string")


def test_stage_timing_by_device(spark):
    edges = [("datasource", "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "sink"), ("c", "sink")]
    nodes, links = graph(spark, edges, [("datasource", "edge", 1.0, 0.0, 0.0), ("a", "edge", 10.0, 0.0, 0.0), ("b", "server", 5.0, 0.0, 0.0), ("c", "edge", 7.0, 0.0, 0.0), ("d", "server", 2.0, 0.0, 0.0), ("sink", "server", 0.0, 0.0, 0.0)])
    got = {r.node: (r.start_time, r.end_time, r.duty_cycle) for r in C.stage_timing(nodes, links).collect()}
    # a starts after the source's unit; b on another device starts anew; c follows a; d follows b, as c is elsewhere
    want = {"datasource": (0, 0, 18), "a": (1, 11, 18), "b": (0, 5, 18), "c": (11, 18, 18), "d": (5, 7, 18), "sink": (0, 0, 18)}
    assert got == want
    alone = [e for e in edges if e != ("c", "sink")]
    got = {r.node: r.duty_cycle for r in C.stage_timing(nodes, graph(spark, alone, [])[1]).collect()}
    assert got == {"datasource": 18, "a": 18, "b": 7, "c": 18, "d": 7, "sink": 7}  # c's downstream is on another device: its own reach counts


def test_critical_path_takes_a_node_s_own_times(spark):
    nodes, links = graph(spark, [("datasource", "a"), ("datasource", "b"), ("a", "sink"), ("b", "sink")], [("datasource", "e", 9.0, 9.0, 9.0), ("a", "e", 1.0, 2.0, 3.0), ("b", "e", 4.0, 0.0, 0.0), ("sink", "e", 0.5, 0.0, 0.0)])
    assert {r.node: r.start2here for r in C.start_to_here(nodes, links).collect()} == {"datasource": 0, "a": 6, "b": 4, "sink": 6.5}
    assert {r.node: r.start2here_cost for r in C.start_to_here_cost(nodes, links, "max_proc").collect()} == {"datasource": 0, "a": 1, "b": 4, "sink": 5.5}


def test_queue_sizes_are_chained(spark):
    rows = [(990.0, 1000.0, 100.0, 1.0, 10.0), (10.0, 1000.0, 100.0, 100.0, 1.0), (5000.0, 1000.0, 100.0, 1000.0, 4.0)]
    df = spark.createDataFrame(rows, "rate double, prep double, infer double, post double, batch double")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in C.queue_sizes(*[F.col(c) for c in df.columns]).items()]).collect()]
    assert got[0] == (50, 30, 30, 300, 990.0)  # 0.99 ** 2 / 0.02 = 49.005
    assert got[1][:4] == (30, 30, 30, 30)
    assert got[2] == (30, 30, 30, 120, 1000.0)  # overload counts as the least; what passes is what each stage can take


LINKS = "stream string, sender string, receiver string, receiver_type string, task string, model string"
METRICS = "p95_out_queueing_duration_us long, p95_transfer_duration_us long, p95_queueing_duration_us long, p95_total_package_size_b long"


def test_network_profile_takes_every_branch(spark):
    links = [("s", "cam1", "server", "serv", "yolov5n", "yolo_320"), ("s", "cam2", "server", "serv", "carbrand", "cb"), ("s", "cam3", "cam3", "nx", "yolov5n", "yolo_512"), ("s", "server", "server", "serv", "yolov5n", "yolo_640"), ("s", "cam4", "server", "none", "x", "x")]
    arrivals = [("s", "cam1", "server", t, t, *[t % 7] * 4) for t in range(300)]
    profiled = [("serv", "cb", t, t, t, 1, 10 + t, 5000 + t) for t in range(150)] + [("nx", "yolo_512", 1, 1, 3, 1, 4, 9), ("serv", "yolo_640", 1, 1, 8, 1, 9, 7)]
    entries = [("cam2", "server", 1000, 50), ("cam2", "server", 6000, 40), ("server", "server", 10, 77)]
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = E.network_profile(
        d(links, LINKS), d(arrivals, f"stream string, sender string, receiver string, timestamps long, event_id long, {METRICS}"),
        d(profiled, f"receiver_type string, model string, timestamps long, event_id long, {METRICS}"), d(entries, "sender string, receiver string, pkg_size long, latency long"),
    )
    got = {r.sender: tuple(r)[3:] for r in got.select("stream", "sender", "receiver", "out_queue", "transfer", "queue", "size").collect()}
    assert got == {"cam1": (6, 6, 6, 6), "cam2": (149, 50, 159, 5149), "cam3": (3, 0, 4, 512 * 512 * 3), "server": (8, 77, 9, 640 * 640 * 3), "cam4": (None, None, None, None)}


@pytest.mark.parametrize(("mode", "want"), [("max", {5: 50, 10: 50, 15: 70, 20: 70, 99: 30}), ("linear", {5: 50, 10: 50, 15: 60, 20: 70, 99: 30})])
def test_latency_between_entries_of_a_link(spark, mode, want):
    entries = spark.createDataFrame([("a", 10, 50), ("a", 20, 70), ("a", 30, 30), ("b", 7, 1)], "link string, pkg_size long, latency long")
    sizes = spark.createDataFrame([("a", s) for s in want] + [("b", 100), ("c", 1)], "link string, size long")
    got = {(r.link, r["size"]): r.latency for r in E.estimate_latency(sizes, entries, "size", mode, width=4, keys=["link"]).collect()}
    assert got == {**{("a", s): v for s, v in want.items()}, ("b", 100): 1, ("c", 1): None}
