"""Operator 8: exact top-k inner products over norm-sorted vectors.

Vectors become integers (floor of ``scale`` times each component) and are sorted by descending length with distributed
prefix counts, so equal-sized blocks hold vectors of like length. An orthogonal rotation from the vectors' Gram matrix
(the right singular vectors) moves most of every product into the first ``head`` coordinates. The block of longest
vectors gives each query a first threshold; in every other block a candidate is dropped once its partial product plus
the Cauchy-Schwarz bound of the two residuals, or the product of the lengths, stays below the query's threshold. What is left is scored
in exact integers: of 64 bits where the lengths allow it, of any size else.

Queries are the stated set (ids divisible by ``every``), taken in blocks against blocks of candidates, and a block pair is one row, so no task
holds more than two blocks. Blocks stand in order of length, so those that a query block must meet are the first so many, a number found by a distributed prefix count; only these pairs are made.

Defined cases: vectors that are null, empty or hold null or non-finite numbers take no part, nor do rows without an id; of rows that share an id the
smallest vector counts; the zero vector takes part; vectors shorter than the longest are padded with zeros; ties go to the smaller id;
components may be of any finite size: a score above 64 bits stops the query, and one below is told as the least long; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, running_totals, store
from .vectors import usable

_EXACT, _LONGEST = 2.0**52, 2.0**62


def search(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64, head: int = 24, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of every query with all other vectors."""
    rows = usable(table, zeros=True)
    width = store(rows.agg(F.max(F.size("v")).alias("w")), "width").first()[0] or 0

    def integers(batch):
        out = np.zeros((len(batch["v"]), width))  # whole numbers, which doubles hold exactly
        for i, v in enumerate(batch["v"]):
            out[i, : len(v)] = np.floor(np.array(v, np.float64) * scale)
        return {"vec_id": batch["vec_id"], "length": -np.sqrt((out**2).sum(axis=1)), "x": [r.tobytes() for r in out], "one_": [1] * len(out)}

    whole = store(arrow_map(rows, "vec_id long, length double, x binary, one_ long", integers, rows=4096), "integers")
    turn = _rotation(whole, width)
    order = running_totals(whole.select("vec_id", "length", "one_"), [], ["length", "vec_id"], "one_", "at", "lengths")
    some = running_totals(whole.where(F.col("vec_id") % every == 0).select("vec_id", "one_"), [], ["vec_id"], "one_", "at", "queries")
    blocks = _blocks(whole, order, block, "c")
    queries = _blocks(whole, some, query_block, "q")
    topmost = blocks.where("c = 0").select("c", "c_ids", "c_x")
    spec = {"k": k, "width": width, "head": min(head, width), "turn": turn}
    first = _pairs(queries.crossJoin(F.broadcast(topmost)), spec, bounded=False)  # one row of ``block`` vectors
    first = store(first, "first")
    kth = first.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rn") == k)
    bounds = store(kth.select("query_id", F.col("score").alias("kth")), "bounds")
    held = _with_bounds(whole.where(F.col("vec_id") % every == 0), bounds, query_block)
    # how many blocks are long enough for each query block: they are the first ones
    marks = blocks.select((-F.col("c_length")).alias("k"), F.lit(0).alias("side"), F.lit(1).cast("long").alias("one_"), F.lit(-1).cast("long").alias("q"))
    marks = marks.unionByName(held.select((-F.col("q_least")).alias("k"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("one_"), "q"))
    upto = running_totals(marks, [], ["k", "side"], "one_", "upto", "marks").where("side = 1 AND upto > 1")
    fits = store(upto.select("q", F.explode(F.sequence(F.lit(1).cast("long"), F.col("upto") - 1)).alias("c")), "fits")
    rest = _pairs(fits.join(held.select("q", "q_ids", "q_x", "q_kth"), "q").join(blocks.select("c", "c_ids", "c_x"), "c"), spec, bounded=True)
    every_ = first.unionByName(rest)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every_.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rotation(whole: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table, strongest first, from the sum of the vectors' outer products.

    Every task adds up one matrix; the sum that reaches the driver has ``width`` squared numbers.
    """

    def grams(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(width * width)), "g": pa.array(total.reshape(-1))})

    parts = whole.select("x").mapInArrow(grams, "cell long, g double").groupBy("cell").agg(F.sum("g").alias("g")).collect()
    gram = np.zeros(width * width)
    for r in parts:
        gram[r.cell] = r.g
    values, vectors = np.linalg.eigh(gram.reshape(width, width)) if width else (np.zeros(0), np.zeros((0, 0)))
    return vectors[:, np.argsort(-values)]


def _blocks(whole: DataFrame, order: DataFrame, size: int, name: str) -> DataFrame:
    """Consecutive rows of ``order`` packed: block number, ids, vectors and largest length of each block."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        ids = pdf.vec_id.to_numpy(np.int64)
        return pd.DataFrame({name: [int(pdf["at"].iloc[0]) // size], f"{name}_ids": [ids.tobytes()], f"{name}_x": [b"".join(pdf.x)], f"{name}_length": [float(-pdf.length.min())]})

    placed = whole.select("vec_id", "length", "x").join(order.select("vec_id", "at"), "vec_id").withColumn("b", F.floor(F.col("at") / size))
    return store(placed.groupBy("b").applyInPandas(pack, f"{name} long, {name}_ids binary, {name}_x binary, {name}_length double"), "blocks")


def _with_bounds(queries: DataFrame, bounds: DataFrame, size: int) -> DataFrame:
    """Query blocks with each query's threshold and the least candidate length that can reach any of them.

    Queries are blocked anew, by the length they need, so that a query that needs little does not open a block of others.
    A query without ``k`` results so far has a threshold below every product.
    """
    need = F.when(F.col("kth").isNull() | (F.col("kth") <= 0) | (F.col("length") == 0), 0.0).otherwise(F.col("kth") / -F.col("length") * (1 - 1e-9))
    each = queries.join(bounds.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "x", "one_", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("kth"), need.alias("need"))
    each = store(each, "needs")
    order = running_totals(each.select("vec_id", "need", "one_"), [], ["need", "vec_id"], "one_", "at", "needs")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        return pd.DataFrame({"q": [int(pdf["at"].iloc[0]) // size], "q_ids": [pdf.vec_id.to_numpy(np.int64).tobytes()], "q_x": [b"".join(pdf.x)], "q_kth": [pdf.kth.to_numpy(np.float64).tobytes()], "q_least": [float(pdf.need.min())]})

    placed = each.join(order.select("vec_id", "at"), "vec_id").withColumn("b", F.floor(F.col("at") / size))
    return store(placed.groupBy("b").applyInPandas(pack, "q long, q_ids binary, q_x binary, q_kth binary, q_least double"), "held")


def _pairs(pairs: DataFrame, spec: dict, bounded: bool) -> DataFrame:
    """(query_id, vec_id, score) of each pair of blocks: per query its ``k`` best there that reach its threshold."""
    k, width, head, turn = spec["k"], spec["width"], spec["head"], spec["turn"]

    def run(batch):
        out = {"query_id": [], "vec_id": [], "score": []}
        for i in range(len(batch["c"])):
            q_ids, c_ids = np.frombuffer(batch["q_ids"][i], np.int64), np.frombuffer(batch["c_ids"][i], np.int64)
            q, c = (np.frombuffer(batch[n][i], np.float64).reshape(-1, width) for n in ("q_x", "c_x"))
            kth = _below(np.frombuffer(batch["q_kth"][i], np.float64)) if bounded else np.full(len(q_ids), -np.inf)
            for name, found, score in _best(q_ids, q, kth, c_ids, c, k, head, turn):
                out["query_id"] += [name] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += [max(int(v), -(2**63)) for v in score]
        return out

    columns = ["c", "q_ids", "q_x", "c_ids", "c_x", *(["q_kth"] if bounded else [])]
    return arrow_map(pairs.select(*columns), "query_id long, vec_id long, score long", run, rows=1)


def _exact(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, fits: bool) -> np.ndarray:
    """Inner products of the pairs (i, j) in whole numbers: int64 where every product of lengths fits, else Python's."""
    if fits:
        parts = [np.einsum("ij,ij->i", q[i[s : s + 65536]].astype(np.int64), c[j[s : s + 65536]].astype(np.int64)) for s in range(0, len(i), 65536)]
        return np.concatenate(parts or [np.zeros(0, np.int64)])
    rows, columns = ({r: [int(v) for v in x[r]] for r in np.unique(at).tolist()} for x, at in ((q, i), (c, j)))
    return np.array([sum(u * v for u, v in zip(rows[m], columns[n], strict=True)) for m, n in zip(i.tolist(), j.tolist(), strict=True)], object)


def _below(score):
    """``score``, or a little less where a double cannot tell it from its neighbours."""
    return np.where(np.abs(score) < 2.0**53, score, score - np.abs(score) * 1e-15)


def _best(q_ids, q, kth, c_ids, c, k, head, turn, step: int = 512):
    """Candidates in order of length, ``step`` at a time, each query's threshold rising with what it has found."""
    qr, cr = q @ turn, c @ turn
    q_len, c_len = np.sqrt((q**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
    q_rest, c_rest = np.sqrt((qr[:, head:] ** 2).sum(axis=1)), np.sqrt((cr[:, head:] ** 2).sum(axis=1))
    most = q_len.max(initial=0) * c_len.max(initial=0)
    slack, exact, fits = 1e-9 * (most + 1), most < _EXACT, most < _LONGEST and max(q_len.max(initial=0), c_len.max(initial=0)) < _LONGEST
    ids, scores = [[np.zeros(0, np.int64)] for _ in q_ids], [[np.zeros(0, np.int64 if fits else object)] for _ in q_ids]
    kth = kth.copy()
    top = np.full((len(q_ids), k), -np.inf)
    for at in range(0, len(c_ids), step):
        part = slice(at, at + step)
        on = np.flatnonzero(q_len * c_len[part].max() + slack >= kth)
        if not len(on):
            continue
        bound = qr[on, :head] @ cr[part, :head].T + np.outer(q_rest[on], c_rest[part])
        alive = bound + slack >= kth[on][:, None]
        alive &= q_ids[on][:, None] != c_ids[part][None, :]
        if alive.mean() > 0.05 and exact:
            score = (q[on] @ c[part].T).astype(np.int64)
            i, j = np.nonzero(alive & (score >= kth[on][:, None]))
            value = score[i, j]
        else:
            i, j = np.nonzero(alive)
            value = _exact(q, c, on[i], at + j, fits)
            good = (value >= kth[on[i]]).astype(bool)
            i, j, value = i[good], j[good], value[good]
        ends = np.searchsorted(i, np.arange(len(on) + 1))
        for r in np.flatnonzero(np.diff(ends)).tolist():
            a, b = ends[r], ends[r + 1]
            row = on[r]
            ids[row].append(c_ids[at + j[a:b]])
            scores[row].append(value[a:b])
            best = np.concatenate((top[row], value[a:b].astype(np.float64)))
            top[row] = np.partition(best, len(best) - k)[-k:]
            kth[row] = max(kth[row], _below(top[row].min()))
    for name, found, value in zip(q_ids.tolist(), ids, scores, strict=True):
        found, value = np.concatenate(found), np.concatenate(value)
        order = sorted(range(len(found)), key=lambda n: (-int(value[n]), found[n]))[:k] if not fits else np.lexsort((found, -value))[:k]
        if len(order):
            yield name, found[order], value[order]
