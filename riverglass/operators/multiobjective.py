"""Comparison of agents by the fronts of their objective vectors (all maximised)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pareto(points: DataFrame, key: str, objectives: list[str], parts: tuple[int, ...] = (256, 16)) -> DataFrame:
    """Points that no other of their key dominates.

    Fronts of hashed parts are merged as a tree: those of many small parts first, then of fewer, then of the key. A point
    dominated in its part is dominated, so each level compares only what the one before left.
    """
    for n in parts:
        part = F.pmod(F.xxhash64(*objectives), F.lit(n)).alias("p_")
        points = _undominated(points.select("*", part), [key, "p_"], objectives).drop("p_")
    return _undominated(points, [key], objectives)


def _undominated(points: DataFrame, keys: list[str], objectives: list[str]) -> DataFrame:
    others = points.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(o).alias(f"o_{o}") for o in objectives]).distinct()
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys])
    no_worse = reduce(and_, [F.col(f"o_{o}") >= F.col(o) for o in objectives])
    better = reduce(or_, [F.col(f"o_{o}") > F.col(o) for o in objectives])
    return points.join(others, same & no_worse & better, "left_anti")


def reference_point(points: DataFrame, objectives: list[str]) -> DataFrame:
    """One row: per objective min - 0.05 * (max - min + 1e-12)."""
    return points.agg(*[(F.min(o) - (F.max(o) - F.min(o) + 1e-12) * 0.05).alias(o) for o in objectives])


def hypervolume_2d(front: DataFrame, key: str, x: str, y: str, ref: tuple[float, float]) -> DataFrame:
    """Area that each key's front dominates above ``ref``: strips between neighbours in descending x."""
    rows = front.where((F.col(x) > ref[0]) & (F.col(y) > ref[1])).select(key, x, y).distinct()
    w = Window.partitionBy(key).orderBy(F.desc(x), F.desc(y))
    before = F.coalesce(F.max(y).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float(ref[1])))
    strip = (F.col(x) - ref[0]) * F.greatest(F.col(y) - before, F.lit(0.0))
    return rows.withColumn("strip", strip).groupBy(key).agg(F.sum("strip").alias("hypervolume"))


def _volume(points: np.ndarray, ref: np.ndarray) -> float:
    points = points[(points > ref).all(axis=1)]
    if not len(points):
        return 0.0
    if points.shape[1] == 1:
        return float(points.max() - ref[0])
    order = np.argsort(-points[:, -1], kind="stable")
    points = points[order]
    bounds = np.append(points[1:, -1], ref[-1])
    return float(sum((points[i, -1] - low) * _volume(points[: i + 1, :-1], ref[:-1]) for i, low in enumerate(bounds) if points[i, -1] > low))


def hypervolume(front: DataFrame, key: str, objectives: list[str], ref: list[float]) -> DataFrame:
    """Exact volume for any number of objectives; a key's front is one group. For three, ``hypervolume_3d`` needs no such group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "hypervolume": [_volume(pdf[objectives].to_numpy(float), np.array(ref, float))]})

    return front.select(key, *objectives).groupBy(key).applyInPandas(run, f"{key} {front.schema[key].dataType.simpleString()}, hypervolume double")


def _sliced(points: DataFrame, key: str, floor: float, slices: int) -> tuple[DataFrame, list[float]]:
    """(key, s, own, z, x, y) of distinct points in slices of z, and each slice's floor; points of a slice (own = 1) come with the staircase of all above it (own = 0).

    Slices are cut at quantiles of z. What a slice inherits is the staircase of x and y: each slice's own goes to all slices below, where they merge.
    """
    cuts = points.agg(F.percentile_approx("z", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    bounds = sorted({float(floor), *(c for c in cuts if c > floor)})  # at most ``slices`` numbers
    floors = F.array(*[F.lit(b) for b in bounds])
    points = points.withColumn("s", F.size(F.filter(floors, lambda b: b < F.col("z"))) - 1)

    def staircase(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(key, "s").orderBy(F.desc("x"), F.desc("y")).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("best_", F.max("y").over(w)).where(F.col("best_").isNull() | (F.col("y") > F.col("best_"))).drop("best_")

    steps = staircase(points.select(key, "s", "x", "y")).where("s > 0")
    above = staircase(steps.select(key, F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("s"), "x", "y"))
    inherited = above.select(key, "s", F.lit(0).alias("own"), F.element_at(floors, F.col("s") + 2).alias("z"), "x", "y")
    rows = points.select(key, "s", F.lit(1).alias("own"), "z", "x", "y").unionByName(inherited)
    return rows.repartition(key, "s").sortWithinPartitions(key, "s", "own", F.desc("z"), F.desc("x"), F.desc("y")), bounds


def _rows(parts: Iterator[pd.DataFrame], key: str) -> Iterator[tuple]:
    """((key, s), own, z, x, y), null keys as None."""
    for pdf in parts:
        keys = pdf[key].astype(object).where(pdf[key].notna(), None)
        for k, s, own, z, x, y in zip(keys, pdf.s, pdf.own, pdf.z, pdf.x, pdf.y, strict=True):
            yield (k, s), own, z, x, y


def _named(points: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    return points.select(key, *[F.col(o).cast("double").alias(n) for o, n in zip(objectives, "xyz", strict=True)])


def swept_pareto(points: DataFrame, key: str, objectives: list[str], slices: int = 32) -> DataFrame:
    """Points that no other of their key dominates, in three objectives: a sweep down the third, in slices that are swept apart.

    A point is dominated if the staircase of what came before it holds a step at or beyond it; of equal points all stay.
    """
    kind = points.schema[key].dataType.simpleString()
    real = F.greatest(*[F.col(o).isNull().cast("int") for o in objectives]) == 0
    ordered, _ = _sliced(_named(points.where(real), key, objectives).distinct(), key, float("-inf"), slices)

    def sweep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, stairs, kept = None, None, []
        for now, own, z, x, y in _rows(parts, key):
            if now != name:
                name, stairs = now, _Stairs(float("-inf"), float("-inf"), z)
            if own and not stairs.holds(x, y):
                kept.append((now[0], x, y, z))
            stairs.step(x, y)
            if len(kept) >= 10_000:
                yield frame(kept)
                kept = []
        yield frame(kept)

    def frame(kept: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*kept, strict=True)) or [[]] * 4
        return pd.DataFrame({key: pd.Series(list(columns[0]), dtype=object), **{f"k{n}_": np.array(c, float) for n, c in zip("xyz", columns[1:], strict=True)}})

    front = ordered.mapInPandas(sweep, f"{key} {kind}, kx_ double, ky_ double, kz_ double").withColumnRenamed(key, "kkey_")
    same = reduce(and_, [F.col(o).cast("double") == F.col(f"k{n}_") for o, n in zip(objectives, "xyz", strict=True)], F.col(key).eqNullSafe(F.col("kkey_")))
    return points.join(front, same, "left_semi")


def hypervolume_3d(front: DataFrame, key: str, objectives: list[str], ref: list[float], slices: int = 32) -> DataFrame:
    """Exact volume that each key's points dominate above ``ref``: a sweep down the third objective, in slices that are swept apart.

    A sweep holds one staircase, sorted, and reads its slice's points in order, in Arrow batches.
    """
    kind = front.schema[key].dataType.simpleString()
    inside = reduce(and_, [F.col(o) > r for o, r in zip(objectives, ref, strict=True)])
    ordered, bounds = _sliced(_named(front.where(inside), key, objectives).distinct(), key, ref[2], slices)

    def sweep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, stairs, done = None, None, []

        def close():
            if stairs is not None:
                done.append((name[0], stairs.volume + stairs.area * (stairs.z - bounds[name[1]])))

        for now, _, z, x, y in _rows(parts, key):
            if now != name:
                close()
                name, stairs = now, _Stairs(ref[0], ref[1], z)
            stairs.volume += stairs.area * (stairs.z - z)
            stairs.z = z
            stairs.add(x, y)
        close()
        yield pd.DataFrame({key: pd.Series([k for k, _ in done], dtype=object), "volume": [float(v) for _, v in done]})

    return ordered.mapInPandas(sweep, f"{key} {kind}, volume double").groupBy(key).agg(F.sum("volume").alias("hypervolume"))


class _Stairs:
    """Undominated (x, y), by ascending x and so descending y, and the area below them above a corner."""

    def __init__(self, x0: float, y0: float, z: float):
        self.xs, self.ys, self.x0, self.y0 = [], [], x0, y0
        self.area, self.volume, self.z = 0.0, 0.0, z

    def holds(self, x: float, y: float) -> bool:
        """Whether a step lies at or beyond (x, y) in both."""
        end = bisect_left(self.xs, x)
        return end < len(self.xs) and self.ys[end] >= y

    def step(self, x: float, y: float) -> tuple[int, list] | None:
        """Put (x, y) in, for the steps that it dominates; where it went and what they were, or None if it is dominated."""
        if self.holds(x, y):
            return None
        end = bisect_left(self.xs, x)
        end += end < len(self.xs) and self.xs[end] == x  # the lower of two with one x
        start = end
        while start and self.ys[start - 1] <= y:
            start -= 1
        gone = list(zip(self.xs[start:end], self.ys[start:end], strict=True))
        self.xs[start:end], self.ys[start:end] = [x], [y]
        return start, gone

    def add(self, x: float, y: float) -> None:
        """``step``, and the area that it adds."""
        placed = self.step(x, y)
        if placed is None:
            return
        start, gone = placed
        right = self.ys[start + 1] if start + 1 < len(self.ys) else self.y0
        left = before = self.xs[start - 1] if start else self.x0
        self.area += (x - left) * (y - right)
        for gx, gy in gone:
            self.area -= (gx - before) * (gy - right)
            before = gx


def spread(dimensions: int) -> list[int]:
    """Steps, in 1 / 2**32, of an evenly spread sequence of points: powers of the root of x ** (d + 1) = x + 1."""
    root = 2.0
    for _ in range(60):
        root = (1 + root) ** (1 / (dimensions + 1))
    return [int(root ** -(i + 1) % 1 * 2**32) | 1 for i in range(dimensions)]


def hypervolume_sampled(front: DataFrame, key: str, objectives: list[str], ref: list[float], top: list[float], samples: int = 20_000) -> DataFrame:
    """Sampled volume: the share of evenly spread points of the box that some front point dominates.

    A point follows from its number, so the answer does not depend on how the sample is dealt out.
    """
    at = lambda step: ((F.col("id") + 1) * step % 2**32) / F.lit(float(2**32))
    points = front.sparkSession.range(samples).select("id", *[(F.lit(float(low)) + at(step) * (high - low)).alias(f"r_{o}") for o, low, high, step in zip(objectives, ref, top, spread(len(objectives)), strict=True)])
    inside = reduce(and_, [F.col(o) >= F.col(f"r_{o}") for o in objectives])
    hits = front.join(F.broadcast(points), inside).select(key, "id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))  # the sample is of a set size
    volume = float(np.prod([h - low for low, h in zip(ref, top, strict=True)]))
    return hits.select(key, (F.col("n") / samples * volume).alias("hypervolume"))


def _distance(objectives: list[str], a: str = "a_", b: str = "b_") -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [F.pow(F.col(f"{a}{o}") - F.col(f"{b}{o}"), 2) for o in objectives]))


def _packed(fronts: DataFrame, key: str, objectives: list[str], block: int) -> DataFrame:
    """(k, block, points): each key's points dealt by a hash to blocks of about ``block``, as arrays of coordinates."""
    sizes = fronts.groupBy(F.col(key).alias("k")).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = fronts.select(F.col(key).alias("k"), F.array(*[F.col(o).cast("double") for o in objectives]).alias("x")).join(sizes, "k")
    return rows.groupBy("k", F.pmod(F.xxhash64("x"), F.col("blocks")).alias("block")).agg(F.array_sort(F.collect_list("x")).alias("points"))


def _between(p: list, q: list) -> np.ndarray:
    a, b = np.array(p, float), np.array(q, float)
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def sparsity(front: DataFrame, key: str, objectives: list[str], block: int = 512) -> DataFrame:
    """Mean distance over the pairs of each front; 0 for fewer than two points. Blocks of a front meet, and a pair of blocks tells a sum and a number."""
    packed = _packed(front, key, objectives, block)
    both = packed.join(packed.select("k", F.col("block").alias("other"), F.col("points").alias("q")), "k").where("block <= other")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            sums, pairs = [], []
            for same, p, q in zip(pdf.block == pdf.other, pdf.points, pdf.q, strict=True):
                d = _between(list(p), list(q))
                sums.append(float(np.triu(d, 1).sum() if same else d.sum()))
                pairs.append(len(p) * (len(p) - 1) // 2 if same else d.size)
            yield pd.DataFrame({"k": pdf.k, "total": np.array(sums, float), "pairs": np.array(pairs, np.int64)})

    kind = front.schema[key].dataType.simpleString()
    per = both.mapInPandas(run, f"k {kind}, total double, pairs long").groupBy(F.col("k").alias(key)).agg(F.coalesce(F.try_divide(F.sum("total"), F.sum("pairs")), F.lit(0.0)).alias("sparsity"))
    return per


def front_distances(fronts: DataFrame, key: str, objectives: list[str], block: int = 512) -> DataFrame:
    """(a, b, hausdorff, avg_min, centroid) for every ordered pair of keys.

    The pairs of keys are listed first (they are the result); a block of one front then meets a block of another by equi-joins on them. Of a pair of blocks
    come each point's least distance to the other block, so there is no row per pair of points.
    """
    packed = _packed(fronts, key, objectives, block)
    keys = fronts.select(F.col(key).alias("k")).distinct()
    pairs = keys.withColumnRenamed("k", "a").crossJoin(keys.withColumnRenamed("k", "b"))
    own = packed.select(F.col("k").alias("a"), F.col("block").alias("own"), F.col("points").alias("p"))
    both = pairs.join(own, "a").join(packed.select(F.col("k").alias("b"), F.col("points").alias("q")), "b")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a, b, own_, p, q in zip(pdf.a, pdf.b, pdf.own, pdf.p, pdf.q, strict=True):
                d = _between(list(p), list(q)).min(axis=1)
                yield pd.DataFrame({"a": [a] * len(d), "b": [b] * len(d), "own": [own_] * len(d), "at": np.arange(len(d)), "d": d})

    kind = fronts.schema[key].dataType.simpleString()
    met = both.mapInPandas(run, f"a {kind}, b {kind}, own long, at long, d double")
    least = met.groupBy("a", "b", "own", "at").agg(F.min("d").alias("d"))
    one_way = least.groupBy("a", "b").agg(F.max("d").alias("far"), F.avg("d").alias("avg_min"))
    back = one_way.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("far").alias("far_back"))
    ca, cb = (fronts.groupBy(F.col(key).alias(n)).agg(*[F.avg(o).alias(f"{s}{o}") for o in objectives]) for n, s in (("a", "a_"), ("b", "b_")))
    centres = pairs.join(ca, "a").join(cb, "b").select("a", "b", _distance(objectives).alias("centroid"))
    return one_way.join(back, ["a", "b"]).join(centres, ["a", "b"]).select("a", "b", F.greatest("far", "far_back").alias("hausdorff"), "avg_min", "centroid")


def wasserstein(points: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """(a, b, wasserstein) for keys a < b: the mean over objectives of the area between the two samples' distribution functions."""
    long = points.select(key, F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col(o).alias("x")) for o in objectives])).alias("v")).select(key, "v.*")
    weighted = long.join(long.groupBy(key, "o").agg(F.count(F.lit(1)).alias("n")), [key, "o"]).withColumn("w", F.lit(1.0) / F.col("n"))
    keys = points.select(F.col(key).alias("k_")).distinct()
    pairs = keys.withColumnRenamed("k_", "a").crossJoin(keys.withColumnRenamed("k_", "b")).where("a < b")
    left = pairs.join(weighted, F.col("a") == F.col(key)).select("a", "b", "o", "x", "w")
    right = pairs.join(weighted, F.col("b") == F.col(key)).select("a", "b", "o", "x", (-F.col("w")).alias("w"))
    steps = left.unionByName(right).groupBy("a", "b", "o", "x").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("a", "b", "o").orderBy("x")
    gaps = steps.select("a", "b", "o", (F.abs(F.sum("w").over(w)) * (F.lead("x").over(w) - F.col("x"))).alias("area"))
    return gaps.groupBy("a", "b", "o").agg(F.sum("area").alias("d")).groupBy("a", "b").agg(F.avg("d").alias("wasserstein"))


def matrix(pairs: DataFrame, value: str, keys: list) -> DataFrame:
    """K by K table of a measure of ordered pairs, rounded to six digits."""
    return pairs.groupBy("a").pivot("b", keys).agg(F.round(F.first(value), 6))
