"""Operator 6: approximate nearest neighbours on shifted space-filling curves.

Each of ``orders`` orderings projects the vectors on ``axes`` random orthonormal directions, shifts the grid at random and
sorts by position on a Hilbert curve. The rows are range-partitioned by (ordering, position), distributed prefix counts give ranks,
and a query meets all vectors within ``window`` (a share of all vectors, half to each side) in any ordering; the candidates
of all orderings merge and are ranked by exact distance. Exact copies of a vector take one place on the curves and bring their smallest ids along,
so no window fills up with copies. The grid's bounds come from a sample of at most ``sample_rows`` vectors; every vector is indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do rows without an id; of rows
that share an id the smallest vector counts; vectors shorter than the longest are padded with zeros; ties go to the smaller id; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, hash_sample, running_totals, store
from .hilbert import hilbert_key
from .vectors import element_type, stack, usable


def search(table: DataFrame, k: int = 10, every: int = 100, orders: int = 24, axes: int = 8, window: float = 0.04, sample_rows: int = 4096, seed: int = 5, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``every``."""
    rows = usable(table, zeros=False)
    kind = element_type(rows)
    rows = store(rows, "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    pack = lambda batch: {"vec_id": batch["vec_id"], "v": [np.array(x, kind).tobytes() for x in batch["v"]]}
    few = Window.partitionBy("v").orderBy("vec_id")
    copies = rows.withColumn("rn", F.row_number().over(few)).where(F.col("rn") <= k + 1).groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    copies = store(copies, "distinct")
    points = store(arrow_map(copies.select("vec_id", "v"), "vec_id long, v binary", pack), "points")
    queries = store(arrow_map(rows.where(F.col("vec_id") % every == 0), "vec_id long, v binary", pack), "queries")
    n = points.count()
    curves = _curves(points, width, kind, orders, axes, sample_rows, seed)

    def keys(batch):
        x = stack(batch["v"], width, kind)
        found = np.stack([curve(x) for curve in curves], axis=1) if len(x) else np.zeros((0, orders), np.int64)
        return {"vec_id": batch["vec_id"], "is_point": batch["is_point"], "keys": list(found)}

    both = points.withColumn("is_point", F.lit(1).cast("long")).unionByName(queries.withColumn("is_point", F.lit(0).cast("long")))
    keyed = arrow_map(both, "vec_id long, is_point long, keys array<long>", keys, rows=2048).select("vec_id", "is_point", F.posexplode("keys").alias("t", "key"))
    placed = running_totals(store(keyed, "keys"), ["t"], ["key", "is_point", "vec_id"], "is_point", "at", "curves")
    half = int(np.ceil(n * window / 2)) + k
    block = int(min(max(block, half // 4), 16384))
    own = placed.where("is_point = 1").groupBy("vec_id").agg(F.collect_list(F.struct("t", F.floor(F.col("at") / block).alias("b"), "at")).alias("places"))
    first, last = F.floor(F.greatest(F.col("at") - half, F.lit(0)) / block), F.floor((F.col("at") + half) / block)
    met = placed.where("is_point = 0").groupBy("vec_id").agg(F.collect_list(F.struct("t", F.sequence(first, last).alias("bs"), "at")).alias("places"))
    left = points.join(own, "vec_id").select("vec_id", "v", F.inline("places"))
    right = queries.join(met, "vec_id").select("vec_id", "v", F.inline("places")).select("vec_id", "v", "t", "at", F.explode("bs").alias("b"))

    def near(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"query_id": [], "rep": [], "score": []}).astype({"query_id": "int64", "rep": "int64", "score": "float64"})
        x, names, ranks = stack(list(p.v), width, kind), p.vec_id.to_numpy(), p["at"].to_numpy()
        norms, out = (x**2).sum(axis=1), []
        for at in range(0, len(q), 256):
            part = q.iloc[at : at + 256]
            y = stack(list(part.v), width, kind)
            d = norms[None, :] - 2 * (y @ x.T)
            d[np.abs(ranks[None, :] - part["at"].to_numpy()[:, None]) > half] = np.inf
            best = np.argpartition(d, k + 5, axis=1)[:, : k + 6] if d.shape[1] > k + 6 else np.tile(np.arange(d.shape[1]), (len(d), 1))
            for i, query in enumerate(part.vec_id.to_numpy()):
                c = best[i][d[i, best[i]] < np.inf]
                score = np.sqrt(((x[c] - y[i]) ** 2).sum(axis=1))
                top = np.lexsort((names[c], score))[: k + 1]
                out.append(pd.DataFrame({"query_id": query, "rep": names[c][top], "score": score[top]}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("t", "b").cogroup(right.groupBy("t", "b")).applyInPandas(near, "query_id long, rep long, score double")
    merged = store(found.groupBy("query_id", "rep").agg(F.min("score").alias("score")), "merged")
    ids = copies.select(F.col("vec_id").alias("rep"), "ids")
    each = merged.join(ids, "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _curves(points: DataFrame, width: int, kind: str, orders: int, axes: int, sample_rows: int, seed: int) -> list:
    """One function per ordering, from vectors to positions on its curve."""
    taken = hash_sample(points, "vec_id", sample_rows, "curves").select("v").collect()
    x = stack([bytes(r.v) for r in taken], width, kind)
    if not len(x):
        return []
    rng = np.random.default_rng(seed)
    axes = min(axes, width)
    bits = min(10, 62 // axes)
    out = []
    for _ in range(orders):
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :axes]
        p = x @ turn
        low, high = p.min(axis=0), p.max(axis=0)
        shift, scale = rng.random(axes), np.where(high > low, high - low, 1.0)

        def curve(v, turn=turn, low=low, scale=scale, shift=shift):
            cells = (np.clip((v @ turn - low) / scale, 0, 1) + shift) / 2 * (2**bits - 1)
            return hilbert_key(cells, bits)

        out.append(curve)
    return out
