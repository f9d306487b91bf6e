"""Sweeps, grids, sketches and catalog tables against plain versions."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverglass import catalog
from riverglass.functions import quantiles as Q
from riverglass.operators import detection as D
from riverglass.operators import joins as J
from riverglass.operators import multiobjective as M
from riverglass.operators import rollup as R
from riverglass.session import scratch
from riverglass.sources import readers, sinks


@pytest.mark.parametrize("slices", [1, 4, 32])
def test_swept_volume_matches_recursion(spark, slices):
    rng = np.random.default_rng(slices)
    points = {k: np.round(rng.uniform(0, 1, (n, 3)), 1 if k == "ties" else 9) for k, n in (("a", 150), ("ties", 120), ("one", 1))}
    rows = [(k, *map(float, p)) for k, x in points.items() for p in x] + [("below", -1.0, 0.5, 0.5), (None, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    got = {r.k: r.hypervolume for r in M.hypervolume_3d(df, "k", ["x", "y", "z"], [0.0, 0.0, 0.0], slices).collect()}
    want = {k: M._volume(x, np.zeros(3)) for k, x in points.items()} | {None: 0.125}
    assert got == pytest.approx(want)
    assert M.hypervolume_3d(df.limit(0), "k", ["x", "y", "z"], [0.0] * 3).count() == 0


@pytest.mark.parametrize("slices", [1, 5, 32])
def test_swept_front_matches_all_pairs(spark, slices):
    rng = np.random.default_rng(slices)
    rows = [(k, i, *map(float, p)) for k, digits, n in (("a", 9, 300), ("ties", 1, 300), (None, 1, 40)) for i, p in enumerate(np.round(rng.uniform(-1, 1, (n, 3)), digits))]
    rows += [("a", 900, None, 1.0, 1.0), ("one", 1, -5.0, -5.0, -5.0)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double, z double").withColumn("s", F.lit("kept"))
    got = sorted((r.k or "", r.i) for r in M.swept_pareto(df, "k", ["x", "y", "z"], slices).collect())
    real = [r for r in rows if r[2] is not None]
    better = lambda p, q: p[0] == q[0] and all(a >= b for a, b in zip(p[2:], q[2:], strict=True)) and p[2:] != q[2:]
    assert got == sorted((q[0] or "", q[1]) for q in real if not any(better(p, q) for p in real))


@pytest.mark.parametrize("block", [7, 512])
def test_distances_between_fronts_by_blocks(spark, block):
    rng = np.random.default_rng(block)
    fronts = {k: np.round(rng.uniform(0, 9, (n, 3)), 1) for k, n in (("a", 60), ("b", 41), ("c", 1))}
    fronts["a"][3] = fronts["a"][4]
    df = spark.createDataFrame([(k, *map(float, p)) for k, x in fronts.items() for p in x], "k string, x double, y double, z double")
    got = {(r.a, r.b): (r.hausdorff, r.avg_min, r.centroid) for r in M.front_distances(df, "k", ["x", "y", "z"], block).collect()}
    apart = {(a, b): np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)) for a, p in fronts.items() for b, q in fronts.items()}
    for (a, b), d in apart.items():
        centre = np.sqrt(((fronts[a].mean(axis=0) - fronts[b].mean(axis=0)) ** 2).sum())
        assert got[a, b] == pytest.approx((max(d.min(axis=1).max(), d.min(axis=0).max()), d.min(axis=1).mean(), centre))
    spread = {r.k: r.sparsity for r in M.sparsity(df, "k", ["x", "y", "z"], block).collect()}
    assert spread == pytest.approx({k: apart[k, k][np.triu_indices(len(p), 1)].mean() if len(p) > 1 else 0.0 for k, p in fronts.items()})


def test_staircase_area():
    rng = np.random.default_rng(1)
    stairs, points = M._Stairs(0.0, 0.0, 0.0), []
    for _ in range(300):
        x, y = np.round(rng.uniform(0.1, 1, 2), 1)
        stairs.add(x, y)
        points.append((x, y))
        assert stairs.area == pytest.approx(M._volume(np.array(points), np.zeros(2)))


@pytest.mark.parametrize("cell", [7, 64, 1000])
def test_boxes_meet_once_in_the_grid(spark, cell):
    rng = random.Random(cell)
    boxes = [(i, i % 2, x := rng.randrange(-100, 300), y := rng.randrange(-50, 200), x + rng.randrange(0, 90), y + rng.randrange(0, 40)) for i in range(250)]
    schema = "{0} long, img long, {0}_x1 long, {0}_y1 long, {0}_x2 long, {0}_y2 long".format
    names = lambda s: tuple(f"{s}_{c}" for c in ("x1", "y1", "x2", "y2"))
    a, b = (spark.createDataFrame(boxes, schema(s)) for s in "ab")
    got = sorted((r.a, r.b, r.shared) for r in D.overlapping(a, b, "img", names("a"), names("b"), cell).collect())
    area = lambda p, q: max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
    assert got == sorted((p[0], q[0], area(p, q)) for p in boxes for q in boxes if p[1] == q[1] and area(p, q) > 0)


def test_merged_sketches_stay_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 24).alias("hour"), F.lit("k").alias("k"), (F.col("id") * 7919 % 60_013).alias("x"))
    parts = Q.sketches(df, ["k", "hour"], "x")
    assert parts.agg(F.max(F.length("sketch"))).first()[0] < 10_000
    got = Q.merged(parts, ["k"], {"p5": 0.05, "p95": 0.95}).first()
    xs = sorted(i * 7919 % 60_013 for i in range(60_000))
    assert got.n == 60_000
    for found, rank in ((got.p5, 0.05), (got.p95, 0.95)):
        assert abs(np.searchsorted(xs, found) / 60_000 - rank) < 2 * Q.RANK_ERROR


def test_mean_distance_to_a_buffer(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.2]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, p double, q double, r double")
    got = {r.i: r.distance for r in R.mean_mahalanobis(df, df.where("i < 30"), ["p", "q", "r"]).collect()}
    inverse = np.linalg.inv(np.cov(x[:30], rowvar=False) + 1e-6 * np.eye(3))
    want = {i: np.mean([np.sqrt((v - h) @ inverse @ (v - h)) for h in x[:30]]) for i, v in enumerate(x)}
    assert got == pytest.approx(want)
    assert R.mean_mahalanobis(df, df.limit(1), ["p"]).where("distance IS NOT NULL").count() == 0


def test_tables_of_a_keyword_are_united_and_pruned(spark):
    mark = f"t{uuid.uuid4().hex}"
    df = spark.range(60).select("id", (F.col("id") * 2).alias("v"), F.concat(F.lit("stream"), F.col("id") % 3).alias("stream"))
    sinks.save_fact(df.where("id < 40"), f"{mark}_a_arr", scratch(spark, "fact"), ["stream"])
    sinks.save_fact(df.where("id >= 40").drop("v"), f"{mark}_b_arr", scratch(spark, "fact"), ["stream"])
    sinks.save_fact(df, f"{mark}_a_hw", scratch(spark, "fact"), ["stream"])
    try:
        rows = readers.load_facts(spark, f"{mark}_*_arr", stream="1")
        assert sorted((r.id, r.v) for r in rows.collect()) == [(i, i * 2 if i < 40 else None) for i in range(1, 60, 3)]
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("PartitionFilters: [") == 2 and plan.count("Contains(stream") == 2 and "id=" not in plan
        assert readers.load_facts(spark, f"{mark}_none") is None
        assert readers.scan_table(spark, f"{mark}_none", "a long", ["a"]).count() == 0
        assert readers.scan_table(spark, f"{mark}_a_hw", "id long", ["id"]).count() == 60
    finally:
        for name in ("a_arr", "b_arr", "a_hw"):
            spark.sql(f"DROP TABLE IF EXISTS {mark}_{name}")


@pytest.mark.parametrize("name", ["d3_class_routing", "b26_class_of_interest"])
def test_routing_moves_no_detections(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with detections and edges of unknown size
    try:
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # of the counts


def test_routing_takes_null_and_other_classes(spark):
    edges = spark.createDataFrame([("face", 0), ("odd", -2), ("sink", -1)], "dst string, coi long")
    df = spark.createDataFrame([(1, 0), (2, None), (3, -2), (4, -1), (5, 7)], "det_id long, class_id long")
    got = sorted((r.det_id, r.dst) for r in J.route(df, edges).collect())
    assert got == [(1, "face"), (1, "sink"), (2, "sink"), (3, "odd"), (3, "sink"), (4, "sink"), (5, "sink")]


@pytest.mark.parametrize("top, keep, rows_a_batch", [(None, None, 7), (40, None, 16), (60, 9, 7), (None, 5, 1000)])
def test_suppression_of_images_across_batches(spark, top, keep, rows_a_batch):
    rng = np.random.default_rng(3)
    images = [None] * 50 + ["a"] * 150 + ["b"] * 3 + ["c"] + ["d"] * 90
    rows = [(k, i, *map(int, (x := rng.integers(0, 40, 2))), *map(int, x + rng.integers(1, 25, 2)), float(rng.integers(0, 8)) / 8) for i, k in enumerate(images)]
    df = spark.createDataFrame(rows, "image_id string, det_id long, x1 long, y1 long, x2 long, y2 long, score double")

    def covers(a, b):
        w, h = (max(0, min(a[i + 2], b[i + 2]) - max(a[i], b[i]) + 1) for i in (2, 3))
        return w * h > 0.4 * (sum((z[4] - z[2] + 1) * (z[5] - z[3] + 1) for z in (a, b)) - w * h)

    want = set()
    for k in set(images):
        out = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[6], r[1]))[:top]:
            if not any(covers(o, r) for o in out):
                out.append(r)
        want |= set(out[:keep])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = D.suppress(df, ["image_id"], 0.4, plus=1, top=top, order=("det_id",), keep=keep).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["f11_nms", "f12_nms_top_k", "f13_filter_chain"])
def test_suppression_shuffles_once(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "MapInPandas" not in plan


@pytest.mark.parametrize("chain", [False, True])
def test_suppression_takes_null_ids_last(spark, chain):
    rows = [(1, None, 5, 0, 0, 9, 9, 0.5), (1, 7, None, 1, 1, 9, 9, 0.5), (1, 7, 3, 0, 1, 9, 9, 0.5), (2, None, 4, None, 0, None, 9, 0.5), (2, 8, 4, 0, 0, 9, 9, 0.5)]  # ties of score, as in SQL
    df = spark.createDataFrame(rows, "image_id long, det_id long, sort_key long, x1 long, y1 long, x2 long, y2 long, score double")
    out = D.filter_chain(df, "image_id", ("det_id", "sort_key"), 0.02, 5000, 0.4, 750) if chain else D.suppress(df, ["image_id"], 0.5, top=200, order=("det_id", "sort_key"))
    assert sorted((r.image_id, r.det_id, r.sort_key) for r in out.collect()) == [(1, 7, 3), (2, 8, 4)]
