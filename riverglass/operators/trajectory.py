"""Trajectories, rewards and federated aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _backward(df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: list[str], fold) -> DataFrame:
    """Run ``fold(state, row values) -> (state, outputs)`` from the last step of every episode to the first.

    Rows arrive sorted in Arrow batches and the state is a few numbers, so an episode of any length fits. ``keys`` must not be null.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in out]])

    def run(parts):
        last, state = None, None
        for pdf in parts:
            ids = list(zip(*(pdf[k] for k in keys), strict=True))
            values = list(zip(*(pdf[c].tolist() for c in columns), strict=True))
            got = np.empty((len(pdf), len(out)))
            for i, (key, row) in enumerate(zip(ids, values, strict=True)):
                if key != last:
                    last, state = key, None
                state, got[i] = fold(state, row)
            yield pdf.assign(**{o: got[:, j] for j, o in enumerate(out)})

    back = [F.desc(c) for c in order]
    return df.repartition(*keys).sortWithinPartitions(*keys, *back).mapInPandas(run, schema)


def discounted(df: DataFrame, keys: list[str], order: list[str], gamma: float = 0.99) -> DataFrame:
    """Adds ret: the discounted sum of this and later rewards."""

    def fold(state, row):
        total = row[0] + gamma * (state or 0.0)
        return total, (total,)

    return _backward(df, keys, order, ["reward"], ["ret"], fold)


def advantages(df: DataFrame, keys: list[str], order: list[str], gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """Adds gae: generalised advantage; the value after the last step is 0."""

    def fold(state, row):
        following, gae = state or (0.0, 0.0)
        gae = row[0] + gamma * following - row[1] + gamma * lam * gae
        return (row[1], gae), (gae,)

    return _backward(df, keys, order, ["reward", "value"], ["gae"], fold)


def masked_advantages(df: DataFrame, keys: list[str], order: list[str], gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """Adds gae and ret = gae + value; terminal steps cut the sum, and the last value bootstraps it."""

    def fold(state, row):
        following, gae = state or (row[1], 0.0)
        mask = 0.0 if row[2] else 1.0
        gae = row[0] + gamma * following * mask - row[1] + gamma * lam * mask * gae
        return (row[1], gae), (gae, gae + row[1])

    return _backward(df, keys, order, ["reward", "value", "terminal"], ["gae", "ret"], fold)


def normalised(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds (value - mean) / (sample deviation + 1e-8) per key; single rows stay as they are. The moments join back, so a large key is not one window."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("m_"), F.stddev_samp(value).alias("s_"), F.count(F.lit(1)).alias("n_"))
    return df.join(stats, keys).withColumn(out, F.when(F.col("n_") > 1, (F.col(value) - F.col("m_")) / (F.col("s_") + 1e-8)).otherwise(F.col(value))).drop("m_", "s_", "n_")


def clip(x: Column, bound: float) -> Column:
    return F.least(F.lit(bound), F.greatest(F.lit(-bound), x))


def reward_weighted(thr: Column, lat: Column, over: Column, mem: Column, most_mem: Column, weights: tuple[float, float, float, float] = (1.1, 0.5, 0.1, 0.1), penalty: bool = False) -> Column:
    a, b, c, d = weights
    r = clip(thr * a - lat * b - over * c - mem * d / (most_mem + 1), 1.0)
    return F.when(r < 0, r * 1.1).otherwise(r * -0.9) if penalty else r


def reward_log(thr: Column, lat: Column, slo: Column, mem: Column, most_mem: Column) -> Column:
    inside = (lat <= slo) & (mem <= most_mem)
    r = F.when(inside, F.ln(F.try_divide(thr, lat / slo))).otherwise(F.exp(-lat * mem))
    return clip(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)), 25.0) / 25.0


def reward_accuracy(thr: Column, drops: Column, lat: Column, accuracy: float = 0.9, weight: float = 0.5, penalty: float = 0.1) -> Column:
    r = drops * -(weight * penalty) + thr * (F.lit(accuracy) - lat * weight * 1000)
    return F.nanvl(F.coalesce(r, F.lit(0.0)), F.lit(0.0))


def reward_ratios(thr: Column, lat: Column, mem: Column, slo: Column, fps: Column, mem_slo: Column) -> Column:
    r = ((slo / lat - 1) + (thr / fps - 1) + (mem_slo / (mem + mem_slo) - 1)) / 3
    return F.when((thr > 0) & (lat > 0), r).otherwise(0.0)


def surrogate(ratio: Column, advantage: Column, eps: float = 0.2) -> Column:
    """Clipped policy loss of one step."""
    cut = F.least(F.lit(1 + eps), F.greatest(F.lit(1 - eps), ratio))
    return -F.least(ratio * advantage, cut * advantage)


def rewarded_surrogate(ratio: Column, advantage: Column, reward: Column, eps: float = 0.2) -> Column:
    """Ten times the clipped loss plus exp(-reward), weighed by the smaller of 10 / ratio and 10 / clipped ratio."""
    cut = F.least(F.lit(1 + eps), F.greatest(F.lit(1 - eps), ratio))
    return 10 * (surrogate(ratio, advantage, eps) + F.least(10 / ratio, 10 / cut) * F.exp(-reward))


def episodes(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Sum and mean of every episode's reward, and whether its mean is a new best of its agent (from 0 on)."""
    per = df.groupBy(*keys, order).agg(F.sum("reward").alias("total"), F.avg("reward").alias("mean"))
    before = F.max("mean").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("is_best", F.col("mean") > F.greatest(F.coalesce(before, F.lit(0.0)), F.lit(0.0)))


def parameters(updates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per parameter of an update: keys, idx, w. A cluster's clients spread over (layer, idx), so none is one group."""
    return updates.select(*keys, F.posexplode("weights").alias("idx", "w")).withColumn("w", F.col("w").cast("double"))


def fed_avg(updates: DataFrame, globals_: DataFrame, keys: list[str]) -> DataFrame:
    """(global + sum of the clients) / (n + 1) per parameter."""
    sums = parameters(updates, keys).groupBy(*keys, "idx").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n"))
    return globals_.join(sums, [*keys, "idx"]).select(*keys, "idx", ((F.col("g") + F.col("s")) / (F.col("n") + 1)).alias("w"))


def head_average(updates: DataFrame, keys: list[str], client: str, eps: float = 1e-6) -> DataFrame:
    """The first client's copy plus later ones weighted by 1 / (loss - the client before's loss), over the number of distinct sizes."""
    w = Window.partitionBy(*keys).orderBy(client)
    gap = F.col("latest_loss") - F.lag("latest_loss").over(w)
    weight = F.when(F.row_number().over(w) == 1, 1.0).when(F.abs(gap) < eps, 1 / eps).otherwise(1 / gap)
    sized = updates.withColumn("size", F.size("weights")).withColumn("weight", weight)
    kinds = sized.groupBy(*keys).agg(F.count_distinct("size").alias("kinds"))
    rows = sized.select(*keys, "weight", F.posexplode("weights").alias("idx", "w"))
    return rows.groupBy(*keys, "idx").agg(F.sum(F.col("w").cast("double") * F.col("weight")).alias("s")).join(kinds, keys).select(*keys, "idx", (F.col("s") / F.col("kinds")).alias("w"))


def soft_update(old: DataFrame, new: DataFrame, keys: list[str], tau: float = 0.005) -> DataFrame:
    return old.withColumnRenamed("w", "a_").join(new.withColumnRenamed("w", "b_"), keys).select(*keys, (F.col("a_") * (1 - tau) + F.col("b_") * tau).alias("w"))


def participation(updates: DataFrame, round_: str, client: str, clients: int) -> DataFrame:
    return updates.groupBy(round_).agg(F.count_distinct(client).alias("n")).where(F.col("n") >= clients // 2)
