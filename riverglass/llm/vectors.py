"""Vector tables: which rows take part, and vectors as bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sound(v: Column, zeros: bool) -> Column:
    """Whether ``v`` is a non-empty vector of finite numbers, not all of them zero unless ``zeros``."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)
    return F.coalesce(ok if zeros else ok & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(table: DataFrame, zeros: bool) -> DataFrame:
    """(vec_id, v): rows with an id and a non-empty vector of finite numbers; without ``zeros`` the zero vector is left out.

    Of rows that share an id, the one with the smallest vector counts.
    """
    v = F.col("embedding")
    return table.where(sound(v, zeros) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def element_type(df: DataFrame) -> str:
    """numpy's name for the elements of column v: floats keep four bytes."""
    return "f4" if isinstance(df.schema["v"].dataType.elementType, T.FloatType) else "f8"


def stack(rows, width: int, kind: str) -> np.ndarray:
    """Vectors given as bytes, as a matrix of doubles; shorter ones are padded with zeros."""
    if all(len(r) == width * int(kind[1]) for r in rows):
        return np.frombuffer(b"".join(rows), kind).reshape(len(rows), width).astype(np.float64)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x = np.frombuffer(r, kind)
        out[i, : len(x)] = x
    return out
