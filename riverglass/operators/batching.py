"""Batches and samples over ordered streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import numbered


def fixed_batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds batch (from 0) and is_full: every ``size`` items in order; the tail stays open."""
    w = Window.partitionBy(*keys)
    batch = F.floor((F.row_number().over(w.orderBy(*order)) - 1) / size)
    return df.withColumns({"batch": batch, "n_": F.count(F.lit(1)).over(w)}).withColumn("is_full", (F.col("batch") + 1) * size <= F.col("n_")).drop("n_")


def timed_batches(df: DataFrame, keys: list[str], at: str, tie: str, size: int, wait: int) -> DataFrame:
    """Adds batch: closed at ``size`` items, or when an item arrives after the oldest has waited more than ``wait``.

    The rows of a key are read in order, in Arrow batches; only the open batch's start and fill are kept between them, so a key of any length fits.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])

    def run(parts):
        last, number, start, fill = None, -1, 0, 0
        for pdf in parts:
            out = np.empty(len(pdf), np.int64)
            ids = list(zip(*(pdf[k] for k in keys), strict=True))
            for i, (key, now) in enumerate(zip(ids, pdf[at].tolist(), strict=True)):
                if key != last:
                    last, number, fill = key, -1, size
                if fill >= size or now - start > wait:
                    number, start, fill = number + 1, now, 0
                fill += 1
                out[i] = number
            yield pdf.assign(batch=out)

    return df.repartition(*keys).sortWithinPartitions(*keys, at, tie).mapInPandas(run, schema)


def deadline(slo: Column, waited: Column, prep: Column, infer: Column, post: Column, fill: Column) -> Column:
    """Time a partial batch may still wait: SLO less the wait so far, 1.2 times inference and postprocessing of the fill, and preprocessing."""
    return slo - waited - (infer + post) * fill * 1.2 - prep * 1.2


def frame_packing(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds frame and first_image: groups of ``size`` consecutive images, and the images before the frame."""
    out = df.withColumn("frame", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))
    return out.withColumn("first_image", F.col("frame") * size)


def batch_statistics(batched: DataFrame, keys: list[str]) -> DataFrame:
    per = batched.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("items"), F.avg("n").alias("mean_size"))


def run_segments(df: DataFrame, keys: list[str], order: list[str], frame: str) -> DataFrame:
    """Adds segment: a new one where the frame number falls; segment 0 is the warm-up."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reset = F.when(F.col(frame) < F.lag(frame).over(w), 1).otherwise(0)
    return df.withColumn("reset_", reset).withColumn("segment", F.sum("reset_").over(w)).drop("reset_")


def warm_up_batches(configured: int, size: int) -> int:
    return configured if configured * size >= 120 else 120 // size + 1


def after_warm_up(df: DataFrame, keys: list[str], order: list[str], size: int, configured: int = 100) -> DataFrame:
    """Without the rows of each key's first ``warm_up_batches`` batches of ``size``."""
    skip = warm_up_batches(configured, size) * size
    return numbered(df, keys, order, "rn_").where(F.col("rn_") > skip).drop("rn_")


def trim_to_shortest(df: DataFrame, key: str, frame: str) -> DataFrame:
    """Rows whose frame number is below the number of rows of the shortest stream."""
    shortest = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_")).agg(F.min("n_").alias("least_"))
    return df.crossJoin(F.broadcast(shortest)).where(F.col(frame) < F.col("least_")).drop("least_")  # one row


def score_batches(df: DataFrame, column: str, model, classes: str = "label") -> DataFrame:
    """Adds ``classes``: argmax of what ``model`` (a matrix in, a matrix of class scores out) says of an array column."""
    schema = T.StructType([*df.schema.fields, T.StructField(classes, T.LongType())])

    def run(parts):
        for pdf in parts:
            x = np.stack(pdf[column].to_numpy()) if len(pdf) else np.zeros((0, 1))
            yield pdf.assign(**{classes: np.argmax(model(x), axis=1).astype(np.int64) if len(pdf) else pd.Series(dtype="int64")})

    return df.mapInPandas(run, schema)


def mini_batches(df: DataFrame, keys: list[str], tie: str, epoch: int, size: int = 64, seed: int = 0) -> DataFrame:
    """Adds block: a permutation of every key's rows for this epoch (by hash), cut into blocks of ``size``."""
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(tie))), F.col(tie)]
    return numbered(df, keys, order, "rn_").withColumn("block", F.floor((F.col("rn_") - 1) / size)).drop("rn_")
