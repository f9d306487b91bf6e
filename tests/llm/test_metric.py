"""The exact metric join against all pairs, with and without cuts of cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverglass.llm import metric
from riverglass.llm.common import store


def table(spark, rng, n, dim, kind="float"):
    """Tight groups around centres in two labels, copies, scaled copies, and rows that cannot link."""
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.08 * rng.normal(size=(n, dim)) * rng.choice([0.3, 1, 3], (n, 1))
    x[30:60] = x[30]
    x[60:70] = 2.5 * x[61]
    rows = [(i * 3, [float(c) for c in v], int(i % 4 == 0)) for i, v in enumerate(x.astype(np.float32))]
    rows += [(3, rows[1][1], 1), (9, None, 0), (None, rows[2][1], 0)]  # repeated and missing ids
    rows += [(100_001, None, 0), (100_002, [], 0), (100_003, [0.0] * dim, 1), (100_004, [float("nan")] * dim, 0), (100_005, [None] * dim, 1), (100_006, [float("inf")] + [1.0] * (dim - 1), 1), (100_007, rows[5][1], None), (100_008, [1.0], 1), (100_009, [2.0] + [0.0] * (dim - 1), 1)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("n_links", F.lit("x")).withColumn("cell", F.lit(1)), rows


def all_pairs(rows, least):
    best, ids = {}, {r[0] for r in rows if r[0] is not None}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            best[i] = min(best.get(i, (label, v)), (label, v))
    width = max(len(v) for _, v in best.values())
    order = sorted(best)
    x = np.array([best[i][1] + [0.0] * (width - len(best[i][1])) for i in order])
    label = np.array([best[i][0] for i in order])
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    linked = (x @ x.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    root = {i: i for i in order}
    for at, i in enumerate(order):
        if root[i] == i:
            front = [at]
            while front:
                for j in np.flatnonzero(linked[front.pop()]).tolist():
                    if root[order[j]] == order[j] and order[j] > i:
                        root[order[j]] = i
                        front.append(j)
    counts = dict(zip(order, linked.sum(axis=1).tolist(), strict=True))
    return sorted((i, counts.get(i, 0), root.get(i, i), root.get(i, i) == i) for i in ids)


@pytest.mark.parametrize(("dim", "target", "fan", "gain", "block", "kind"), [(8, 40, 4, 0.95, 16, "float"), (3, 25, 6, 0.9, 8, "double"), (16, 2048, 16, 0.8, 1024, "float")])
def test_links_of_all_pairs(spark, dim, target, fan, gain, block, kind):
    df, rows = table(spark, np.random.default_rng(dim), 500, dim, kind)
    got = sorted(tuple(r) for r in metric.link(df, target=target, fan=fan, gain=gain, worth=0, block=block).collect())
    want = all_pairs(rows, 0.98)
    assert got == want
    assert sum(n for _, n, _, _ in want) > 500


def test_cells_are_cut_where_it_helps(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2)).astype(np.float32)  # directions on a circle
    rows = [("one", v.tobytes(), i, 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "label string, x binary, rep long, weight long")
    placed = store(metric.cells(df, "f4", 0.98, 30, 8, 0.8, 0), "cells")
    assert placed.where("home").count() == 600 == placed.where("home").select("rep").distinct().count()
    assert placed.select("cell").distinct().count() > 10
    work = placed.groupBy("cell").agg((F.sum(F.col("home").cast("int")) * F.count(F.lit(1))).alias("w")).agg({"w": "sum"}).first()[0]
    assert work < 0.35 * 600**2


def test_cells_stay_whole_where_guests_cost_more(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    df = spark.createDataFrame([("one", v.tobytes(), i, 1) for i, v in enumerate(x)], "label string, x binary, rep long, weight long")
    assert metric.cells(df, "f4", 0.98, 50, 8, 0.8, 1000).select("cell").distinct().count() == 1


def test_no_rows(spark):
    df, _ = table(spark, np.random.default_rng(1), 80, 4)
    assert metric.link(df.limit(0)).count() == 0
    assert [tuple(r) for r in metric.link(df.where("vec_id = 100001")).collect()] == [(100_001, 0, 100_001, True)]
