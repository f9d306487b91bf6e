"""Golden and property tests of operators that SQL does not cover, and of edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverglass.functions import quantiles as Q
from riverglass.functions import scalars as S
from riverglass.operators import batching as G
from riverglass.operators import capacity as C
from riverglass.operators import detection as D
from riverglass.operators import experiment as X
from riverglass.operators import joins as J
from riverglass.operators import multiobjective as M
from riverglass.operators import rollup as R
from riverglass.operators import trajectory as T
from riverglass.sources import readers, sinks


def one(df):
    return df.first()


def test_percentiles_differ_at_whole_ranks(spark):
    df = spark.range(1, 21).withColumn("k", F.lit(1))
    assert one(df.agg(Q.nearest_rank("id")))[0] == 19
    assert one(Q.floor_index(df, ["k"], ["id"])).id == 20
    assert one(df.agg(Q.floor_index_small("id")))[0] == 20
    single = spark.range(5, 6).withColumn("k", F.lit(1))
    assert one(Q.floor_index(single, ["k"], ["id"])).id == 5


def test_scalars(spark):
    df = spark.createDataFrame([("[h|s|7|1|2]",), ("",), (None,)], "p string")
    got = df.select(S.frame_id(F.col("p")), S.sender_host(F.col("p")), S.arrival_package_size(F.col("p"))).collect()
    assert tuple(got[0]) == (7, "", 2) and got[1][0] is None and got[2][0] is None
    row = spark.range(1).select(S.remove_substring(F.lit("aabb"), "ab"), S.fraction(F.lit("3/0")), S.fraction(F.lit("3/4")), S.abbreviate(F.lit("server12_unknown9"))).first()
    assert tuple(row) == ("", 0.0, 0.75, "serv12_unkn")


def test_queueing_guards(spark):
    df = spark.createDataFrame([(0.0, 5.0), (5.0, 5.0), (2.0, 4.0)], "r double, s double")
    got = [tuple(r) for r in df.select(C.queueing_us(F.col("r"), F.col("s")), C.queueing_us(F.col("r"), F.col("s"), "zero")).collect()]
    assert got[0][1] == 0 and got[1] == (999999999.0, None) and got[2][0] == pytest.approx(250000.0)


def test_as_of_before_first_step_and_ties(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "a", 99), (4, "b", 1)], "i long, k string, tm long")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0)], "k string, tm long, mbps double")
    got = {r.i: r.mbps for r in J.step_value(left, right, ["k"], "tm", "mbps", 4).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 2.0, 4: None}
    near = {r.i: r.mbps for r in J.nearest(left.union(spark.createDataFrame([(5, "a", 15)], left.schema)), right, ["k"], "tm", "mbps", 4).collect()}
    assert near == {1: 1.0, 2: 1.0, 3: 2.0, 4: None, 5: 1.0}


def brute_nms(boxes, threshold, plus):
    out = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        ok = True
        for o in out:
            w, h = min(b[3], o[3]) - max(b[1], o[1]) + plus, min(b[4], o[4]) - max(b[2], o[2]) + plus
            inter = max(0, w) * max(0, h)
            area = lambda z: (z[3] - z[1] + plus) * (z[4] - z[2] + plus)
            ok &= inter <= threshold * (area(b) + area(o) - inter)
        if ok:
            out.append(b)
    return {b[0] for b in out}


def test_suppression_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 7), *map(int, (x := rng.integers(0, 30, 2))), *map(int, x + rng.integers(1, 20, 2)), float(rng.integers(0, 8)) / 8) for i in range(300)]
    df = spark.createDataFrame(rows, "det_id long, image_id long, x1 long, y1 long, x2 long, y2 long, score double")
    got = {r.det_id for r in D.suppress(df, ["image_id"], 0.4, plus=1, order=("det_id",)).collect()}
    want = set().union(*(brute_nms([(r[0], *r[2:]) for r in rows if r[1] == k], 0.4, 1) for k in range(7)))
    assert got == want
    assert D.suppress(df.limit(0), ["image_id"], 0.4).count() == 0


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 9.0, 3.0, 3.0, 4.0, 6.0)], "x1 double, y1 double, x2 double, y2 double, cx double, cy double, w double, h double")
    r = D.decode(D.encode(df)).first()
    assert [r.d_x1, r.d_y1, r.d_x2, r.d_y2] == pytest.approx([1, 2, 5, 9])


def test_timed_batches_close_on_wait_and_size(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 1, 2, 50, 51, 200])] + [("b", 0, 9)], "k string, at long, i long")
    got = [r.batch for r in G.timed_batches(df, ["k"], "at", "i", 3, 40).orderBy("k", "i").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 0]
    assert max(np.bincount(got[:-1])) <= 3


def test_gae_without_values_is_the_discounted_return(spark):
    df = spark.createDataFrame([("a", s, float(s), 0.0, False) for s in range(40)], "agent string, step long, reward double, value double, terminal boolean")
    ret = {r.step: r.ret for r in T.discounted(df, ["agent"], ["step"]).collect()}
    gae = {r.step: r.gae for r in T.advantages(df, ["agent"], ["step"], lam=1.0).collect()}
    assert ret == pytest.approx(gae)


def test_fronts(spark):
    pts = spark.createDataFrame([("a", i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate([(1, 2, 0), (2, 1, 0), (0, 0, 0), (1, 2, 0), (0, 0, 3)])], "agent string, i long, x double, y double, z double")
    front = M.pareto(pts, "agent", ["x", "y", "z"])
    assert {r.i for r in front.collect()} == {0, 1, 3, 4}
    assert {r.i for r in M.pareto(front, "agent", ["x", "y", "z"]).collect()} == {0, 1, 3, 4}
    flat = M.hypervolume_2d(pts, "agent", "x", "y", (0.0, 0.0)).first().hypervolume
    assert flat == M.hypervolume(pts, "agent", ["x", "y"], [0.0, 0.0]).first().hypervolume == 3.0
    cube = spark.createDataFrame([("a", 1.0, 1.0, 2.0), ("a", 2.0, 2.0, 1.0)], "agent string, x double, y double, z double")
    assert M.hypervolume(cube, "agent", ["x", "y", "z"], [0.0] * 3).first().hypervolume == 5.0
    sampled = M.hypervolume_sampled(cube, "agent", ["x", "y", "z"], [0.0] * 3, [2.0] * 3).first().hypervolume
    assert sampled == pytest.approx(5.0, abs=0.2)
    assert M.sparsity(pts.where("i = 0"), "agent", ["x", "y"]).first().sparsity == 0.0


def test_wasserstein_is_symmetric_and_zero_on_itself(spark):
    a, b = [1.0, 2.0, 5.0], [2.0, 2.5]
    make = lambda p, q: spark.createDataFrame([("p", x) for x in p] + [("q", x) for x in q], "agent string, x double")
    d = lambda p, q: M.wasserstein(make(p, q), "agent", ["x"]).first().wasserstein
    assert d(a, b) == pytest.approx(d(b, a)) and d(a, a) == pytest.approx(0.0)


def test_bucket_of_constant_time_is_the_middle(spark):
    df = spark.createDataFrame([(7, 1.0), (7, 3.0)], "t long, v double")
    r = X.bucket_smooth(df, [], "t", ["v"], 100, 3).first()
    assert (r.bucket, r.v) == (49, 2.0)


def test_average_tail_blends_shrinking_windows(spark):
    a, n = [float(x * x % 17) for x in range(40)], 4
    averages = [sum(a[i : i + n]) / n for i in range(len(a) - n + 1)]
    for i in range(n - 1):
        averages.append((sum(a[-(n - i) :]) / (n - i) + sum(averages[-10:])) / 11)
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(a)] + [("short", 0, 1.0)], "k string, i long, v double")
    got = [(r.k, r.average) for r in X.average_tail(df, ["k"], ["i"], "v", n).orderBy("i").collect()]
    assert got == [("k", pytest.approx(x)) for x in averages[-(n - 1) :]]


def test_smoothing_equals_the_full_fold(spark):
    rng = np.random.default_rng(2)
    xs = rng.random(2000) * 1000
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(xs)], "k string, i long, v double")
    s = xs[0]
    for x in xs[1:]:
        s = s * 0.2 + x * 0.8 if x > s else s * 0.8 + x * 0.2
    assert R.smoothed(df, ["k"], ["i"], "v", 0.2, 0.8).first().smoothed == pytest.approx(s, rel=1e-12)


def test_empty_and_missing_inputs(spark, tmp_path):
    assert readers.scan(spark, f"file://{tmp_path}/none", "a long, b string", ["b"]).collect() == []
    empty = spark.createDataFrame([], "stream string, t0 long, event_id long")
    assert R.per_second(empty, ["stream"]).count() == 0
    assert R.smoothed(empty.withColumn("v", F.lit(1)), ["stream"], ["t0"], "v", 0.2, 0.8).count() == 0


def test_ground_truth_headers_carry_over_splits(spark, tmp_path):
    text = "".join(f"-- img{i}\n" + "".join(f"{i} {j} 3 4\n" for j in range(i % 5)) for i in range(400))
    (tmp_path / "gt.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted((r.image, r.x, r.y) for r in readers.ground_truth(spark, f"file://{tmp_path}/gt.txt").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f"img{i}", float(i), float(j)) for i in range(400) for j in range(i % 5))


def test_prediction_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, 1, 2, 5, 9, 0.5), (1, 11, 0, 0, 2, 2, 0.75), (2, 12, 3, 3, 4, 4, 0.25)], "image_id long, det_id long, x1 long, y1 long, x2 long, y2 long, score double")
    for r in sinks.detection_text(df).collect():
        (tmp_path / f"{r.image}.txt").write_text(r.value)
    got = sorted((r.image, r.idx, r.x, r.w, r.score) for r in readers.predictions(spark, f"file://{tmp_path}").collect())
    assert got == [("1", 0, 0.0, 2.0, 0.75), ("1", 1, 1.0, 4.0, 0.5), ("2", 0, 3.0, 1.0, 0.25)]


def test_pair_operators_have_no_cartesian_product(spark):
    from riverglass.adapters import Domain
    from riverglass.plans import detection_queries as P

    d = Domain(spark, "/root/testdata/sf0.001")
    for build in (P.f9, P.f17, P.f19):
        plan = build(d)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_removal_goes_on_until_nothing_is_left(spark):
    row = spark.range(1).select(S.remove_substring(F.lit("a" * 12 + "b" * 12), "ab"), S.remove_substring(F.lit("xaabby"), "ab"), S.remove_substring(F.lit(""), "ab"), S.remove_substring(F.lit(None).cast("string"), "ab"), S.remove_substring(F.lit("ababaXX"), "aba")).first()
    assert list(row) == ["", "xy", "", None, "baXX"]


def test_equal_detections_stay_apart_in_their_tile(spark):
    df = spark.createDataFrame([(1, 10, 10, 50, 50)] * 2 + [(2, 150, 100, 200, 140), (3, 400, 400, 410, 410)], "id long, x1 long, y1 long, x2 long, y2 long")
    out = D.assign_tile(df, D.tile_layout(F.lit(4), 240, 320, pad=2))
    assert sorted(tuple(r) for r in out.select("id", "tile", "x1", "y1").collect()) == [(1, 0, 10, 10), (1, 0, 10, 10), (2, 1, -11, 100)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert spark.range(1).select(F.size(D.tile_layout(F.lit(0), 240, 320))).first()[0] == 0


def test_levels_of_a_deep_chain(spark):
    from riverglass.operators import capacity as C

    n = 15
    nodes = spark.createDataFrame([("p", f"n{i:02d}", 1.0, 2.0, 3.0) for i in range(n)], "pipeline string, node string, max_proc double, transfer double, queue double")
    edges = spark.createDataFrame([("p", f"n{i:02d}", f"n{i + 1:02d}") for i in range(n - 1)], "pipeline string, src string, dst string")
    assert {r.node: r.start2here for r in C.start_to_here(nodes, edges).collect()}[f"n{n - 1}"] == 6.0 * (n - 1)
    with pytest.raises(ValueError):
        C.start_to_here(nodes, edges.union(spark.createDataFrame([("p", "n14", "n00")], edges.schema)))


def test_slow_smoothing_takes_more_rows(spark):
    xs = [float(i % 7) for i in range(3000)]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, i long, v double")
    s = xs[0]
    for x in xs[1:]:
        s = s * 0.99 + x * 0.01
    assert R.smoothed(df, ["k"], ["i"], "v", 0.99, 0.99).first().smoothed == pytest.approx(s, rel=1e-12)
    with pytest.raises(ValueError):
        R.smoothed(df, ["k"], ["i"], "v", 1.0, 0.5)


def test_json_texts_on_one_line_or_several(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"bandwidth_limits": [\n {"time": 1, "mbps": 2.5},\n {"time": 3, "mbps": 4.0}]}')
    (tmp_path / "b.json").write_text('{"bandwidth_limits": [{"time": 5, "mbps": 1.0}]}\n{"bandwidth_limits": [{"time": 6, "mbps": 2.0}]}\n')
    assert sorted((r.time, r.mbps) for r in readers.bandwidth(spark, f"file://{tmp_path}").collect()) == [(1, 2.5), (3, 4.0), (5, 1.0), (6, 2.0)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "c.json").write_text('{"s": {"car":\n [1, 0]}}')
    assert sorted((r.stream, r.frame, r.objects) for r in readers.frame_objects(spark, f"file://{tmp_path}/f").collect()) == [("s", 0, 1), ("s", 1, 0)]


def test_predictions_of_several_images_in_a_file(spark, tmp_path):
    (tmp_path / "p.txt").write_text("7\n0\n8\n2\n1 2 3 4 0.5\n2 2 3 4 0.25\nimg\n1\n9 9 1 1 1.0\n")
    got = sorted((r.image, r.idx, r.x) for r in readers.predictions(spark, f"file://{tmp_path}").collect())
    assert got == [("8", 0, 1.0), ("8", 1, 2.0), ("img", 0, 9.0)]
