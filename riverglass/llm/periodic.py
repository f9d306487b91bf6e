"""Operator 13: runs of words that repeat with a period, found in overlapping tiles and stitched across them.

A run is a stretch of consecutive words whose smallest period is q, of at least ``max(6, 4 * q)`` words, that no neighbouring word extends.
Word i *matches* at period q if it equals word i + q; a run of length n is a maximal interval of n - q >= 3q matching words.

Every text is cut into tiles once per octave of periods, [Q, 2Q) with Q = 2**k: 8Q words or 2,048 if more, 4Q words shared with the next tile, and 2Q words to look
ahead. In a tile, every Q-th word is a boundary. The Z-function of the words after a boundary, and that of the words before it
read backwards, give for each period how far the match reaches to both sides. Intervals of 2q words or more leave the tile as fragments; every run
lies wholly under fragments that touch or overlap, because tiles share two of the longest periods. Spark then shuffles the fragments (numbers only) by text and period and stitches them.
A fragment whose pattern repeats a shorter pattern is dropped in its tile: the octave of the shorter one has it.

Texts are named by a 128-bit hash in the shuffles, so copies of a text share their fragments and one hot text is summed up before it moves.
Word numbers are exact within a text; no hash decides a match. A text's tiles are made one at a time.

Defined cases: null and empty texts, and those of fewer than six words, have no runs, and a null's collapsed text is empty; texts of any length are tiled whole; repeated rows each get
their result; an empty table gives an empty one; other columns are kept, and ``runs`` and ``collapsed`` get longer names where a table has them already.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fresh, store

_STRIDE, _BATCH = 2048, 1 << 22
RUN = "struct<start:long,length:long,period:long>"


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text without the words that any run contains after that run's first ``period`` words, joined by one space.
    """
    a, b, found, collapsed = fresh(docs, "a_", "b_", "runs", "collapsed")
    named = docs.withColumns({a: F.xxhash64(F.col(text)), b: F.xxhash64(F.lit("second"), F.col(text))})
    intervals = store(_intervals(fragments(named.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(text).alias("text")))), "runs")
    each = intervals.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias(found))
    each = store(each, "runs-of-texts").withColumnsRenamed({"a": a, "b": b})
    joined = named.join(each.hint("shuffle_hash"), [a, b], "left").select(*docs.columns, found)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema) + f", `{collapsed}` string"

    def kept(batch):
        return batch | {collapsed: [_collapse(t, r) for t, r in zip(batch[text], batch[found], strict=True)]}

    whole = arrow_map(joined, schema, kept)
    return whole.withColumn(found, F.coalesce(F.col(found), F.array().cast(f"array<{RUN}>")))


def longest(found: Column) -> Column:
    """The run of greatest length, ties to the smallest start, then period; null if there is none."""
    key = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))
    return F.array_min(F.transform(found, key))


def listing(found: Column) -> Column:
    """Every run's ``start,length,period`` and a line feed."""
    lines = F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.array_join(lines, "")


def fragments(texts: DataFrame) -> DataFrame:
    """Of (a, b, text): (a, b, period, s, e), matching words [s, e) of each text's tiles, each row once."""
    tiles = texts.where(F.col("text").isNotNull()).select("a", "b", F.col("text").cast("binary").alias("text")).mapInArrow(_tiles, "a long, b long, octave int, start long, ids binary")
    return tiles.mapInArrow(_solved, "a long, b long, period long, s long, e long").distinct()


def _intervals(parts: DataFrame) -> DataFrame:
    """Fragments of a text and period that touch or overlap become one; (a, b, start, length, period) of those that are runs."""
    w = Window.partitionBy("a", "b", "period").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(before >= F.col("s"), 0).otherwise(1)
    numbered = parts.withColumn("first", first).withColumn("part", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("a", "b", "period", "part").agg(F.min("s").alias("start"), (F.max("e") - F.min("s") + F.col("period")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(6), 4 * F.col("period"))).select("a", "b", "start", "length", "period")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as numbers within their text, cut into tiles for every octave of periods that fits four times."""
    names = ["a", "b", "octave", "start", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        out, size = [[] for _ in names], 0
        for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
            words, seen = text.split(), {}
            n = len(words)
            ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, n)
            octave = 0
            while n >= max(6, 4 << octave):
                q = 1 << octave
                stride = max(_STRIDE, 8 * q)
                for start in range(0, n - q, stride):
                    if start and n - q <= start + 4 * q:  # the tile before reaches the end
                        break
                    tile = ids[start : start + stride + 6 * q].tobytes()
                    for column, value in zip(out, (a, b, octave, start, tile), strict=True):
                        column.append(value)
                    size += len(tile)
                    if size > _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)
                        out, size = [[] for _ in names], 0
                octave += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, octaves, starts, ids = (batch.column(c).to_pylist() for c in ("a", "b", "octave", "start", "ids"))
        by, size = defaultdict(list), defaultdict(int)
        out = {n: [] for n in ("a", "b", "period", "s", "e")}

        def solve(octave, by=by, size=size, ids=ids, a=a, b=b, starts=starts, out=out):
            rows = by.pop(octave)
            size[octave] = 0
            for at, period, s, e in tile_matches([np.frombuffer(ids[i], np.int32) for i in rows], octave):
                i = rows[at]
                for name, value in zip(out, (a[i], b[i], period, starts[i] + s, starts[i] + e), strict=True):
                    out[name].append(value)

        for i, octave in enumerate(octaves):
            by[octave].append(i)
            size[octave] += len(ids[i])
            if size[octave] > _BATCH:
                solve(octave)
        for octave in list(by):
            solve(octave)
        yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})


def tile_matches(tiles: list[np.ndarray], octave: int) -> Iterator[tuple[int, int, int, int]]:
    """(tile, period, s, e): maximal matching intervals of 2 * period words or more of each tile, primitive patterns of the octave only.

    All tiles are laid end to end, each with its own negative number after it, so that nothing matches across. A boundary and a
    period go on to the Z-functions if the first words (up to 16, and no more than the octave needs) match.
    """
    q = 1 << octave
    pieces, begins, rows = [], [], 0
    for i, ids in enumerate(tiles):
        begins.append(rows)
        pad = q - len(ids) % q
        pieces += [ids.astype(np.int64), np.full(pad, -1 - i)]
        rows += (len(ids) + pad) // q
    x = np.concatenate([*pieces, np.full(17, -1 - len(tiles))])
    grid = x[: rows * q].reshape(rows, q)
    same = grid[1:] == grid[:-1, :1]  # entry (r, c): boundary r * q at period q + c
    same[np.array(begins[1:], np.int64) - 1] = False
    r, c = np.nonzero(same)
    b, y = r * q, r * q + q + c
    for j in range(1, min(q, 15) + 1):
        keep = x[b + j] == x[y + j]
        b, y = b[keep], y[keep]
    owner = np.searchsorted(np.array(begins), b // q, "right") - 1
    tile, ends, at, z, back, top = -1, {}, -1, [], [], 0
    for i, start, period in zip(owner.tolist(), b.tolist(), (y - b).tolist(), strict=True):
        if i != tile:
            tile, ends = i, {}
            low, high = begins[i] * q, begins[i] * q + len(tiles[i])
        if ends.get(period, -1) > start:
            continue
        if start != at:
            at = start
            z = z_values(x[start:high].tolist(), 2 * q)
            first, top = max(low, start - q), min(start + 2 * q, high)
            back = z_values([*x[first:start][::-1].tolist(), -1 - len(tiles), *x[first:top][::-1].tolist()], 4 * q + 1)
            behind = start - first + 1
        ahead, before = z[period], back[behind + top - start - period] if behind > 1 else 0
        ends[period] = start + ahead
        if ahead + before >= 2 * period and not any(z[period // f] >= period - period // f for f in prime_factors(period)):
            yield i, period, start - before - low, start + ahead - low


def z_values(s: list[int], limit: int) -> list[int]:
    """Z-function of ``s`` below ``limit``: how many items from each place on equal the first ones."""
    n = len(s)
    z, left, right = [0] * min(limit, n), 0, 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 16)
def prime_factors(n: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return (*out, n) if n > 1 else tuple(out)


def _collapse(text: str | None, found: list[dict] | None) -> str:
    words = (text or "").encode().split()
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for r in found:
            drop[r["start"] + r["period"]] += 1
            drop[r["start"] + r["length"]] -= 1
        words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
    return b" ".join(words).decode()
