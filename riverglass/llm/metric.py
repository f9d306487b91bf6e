"""Operator 11: all pairs of vectors of one label with a cosine of ``least`` or more, as an exact metric range join.

On unit vectors the cosine is a distance: pairs link within r = sqrt(2 - 2 * least). Vectors that are equal bit by bit are joined once, with their number as
weight. Every label begins as one cell. A cell of more than ``target`` vectors gets ``fan`` pivots, its members with the smallest
hashes; each member's home is its nearest pivot's cell, and it is a guest in every other cell that may hold a home vector within r: by the triangle inequality
its distance d to that pivot is at most (distance to its nearest pivot) + 2r, and at most (radius of the cell's home vectors) + r; and it lies at most r behind the plane
between the pivots. So all neighbours of a vector are members of its home cell. Cells that are still large are cut again. A cell is cut only if that saves more than a share of
``1 - gain`` of its comparisons and more than ``worth`` comparisons for each guest row that has to move: in many dimensions guests cost more than they save, and the cell stays whole.

Cells are joined independently. Members are packed into blocks by a hash, and each pair of blocks, of which one at least is of home vectors, is one row: a matrix product in double
precision, from which come each home vector's number of links and, instead of all links, one edge from each linked vector to the smallest of its part of the
block pair. A dense or hot cell is many such rows, and no task holds more than two blocks. Edges then meet in the search for components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and those with a null label, link with nothing and get a row of their own; rows without an id
get none; of rows that share an id, the smallest usable (label, vector) counts; shorter vectors are padded with zeros; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, connected_components, store
from .vectors import sound, stack

_SLACK = 1e-7  # of distances, which are roots of differences; what passes is compared as a cosine


def link(table: DataFrame, least: float = 0.98, target: int = 8192, fan: int = 16, gain: float = 0.8, worth: int = 1000, block: int = 2048) -> DataFrame:
    """vec_id, n_links (vectors with this label and a cosine of ``least`` or more), component_id (smallest id reachable), kept."""
    element = table.schema["embedding"].dataType.elementType
    kind = "f4" if isinstance(element, T.FloatType) else "f8"
    ok = sound(F.col("embedding"), zeros=False) & F.col("label").isNotNull()
    one = table.where(F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.when(ok, F.struct("label", F.col("embedding").alias("v")))).alias("got"))

    def raw(batch):
        return batch | {"x": [None if v is None else np.array(v, kind).tobytes() for v in batch.pop("v")]}

    rows = store(arrow_map(one.select("vec_id", F.col("got.label").cast("string").alias("label"), F.col("got.v").alias("v")), "vec_id long, label string, x binary", raw, rows=4096), "vectors")
    known = rows.where(F.col("x").isNotNull())
    texts = store(known.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "distinct")
    links = store(_joined(cells(texts, kind, least, target, fan, gain, worth), kind, least, block), "links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")).distinct())
    found = texts.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    found = store(found.select("label", "x", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "found")
    linked = known.join(found, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("x").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def cells(texts: DataFrame, kind: str, least: float, target: int, fan: int, gain: float, worth: int) -> DataFrame:
    """Of (label, x, rep, weight): (cell, rep, x, weight, home), where every vector within reach of a home vector is a member of its cell."""
    now, done = texts.select(F.col("label").alias("cell"), "rep", "x", "weight", F.lit(True).alias("home")), []
    while True:
        sizes = store(_sizes(now), "sizes")
        large = sizes.where(F.col("homes") > target)
        if large.isEmpty():
            break
        near = store(_distances(now, large, kind, least, fan), "near")
        radius = near.where("home").groupBy("cell", "q").agg(F.count(F.lit(1)).alias("homes"), F.max("d").alias("r"))
        radius = store(radius, "radius")
        guests = near.select("cell", "rep", "x", "weight", F.inline("others")).join(radius, ["cell", "q"]).where(F.col("d") <= F.col("r") + _reach(least))
        guests = store(guests.select("cell", "q", "rep", "x", "weight"), "guests")
        work = radius.join(guests.groupBy("cell", "q").agg(F.count(F.lit(1)).alias("guests")), ["cell", "q"], "left")
        guest = F.coalesce("guests", F.lit(0))
        work = work.groupBy("cell").agg(F.sum(F.col("homes") * (F.col("homes") + guest)).alias("work"), F.sum(guest).alias("moved"))
        saved = F.col("homes") * F.col("members") - F.col("work")
        cut = store(work.join(large, "cell").where((saved > (1 - gain) * F.col("homes") * F.col("members")) & (saved > worth * F.col("moved"))).select("cell"), "cut")
        done.append(now.join(cut, "cell", "left_anti"))
        parts = [near.where("home").select("cell", "q", "rep", "x", "weight", F.lit(True).alias("home")), guests.select("*", F.lit(False).alias("home"))]
        now = parts[0].unionByName(parts[1]).join(cut, "cell")
        now = store(now.select(F.concat_ws("/", "cell", "q").alias("cell"), "rep", "x", "weight", "home"), "cells")
    for rest in done:
        now = now.unionByName(rest)
    return now


def _reach(least: float) -> float:
    return float(np.sqrt(2 - 2 * least)) + _SLACK


def _sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("members"))


def _packed(placed: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(cell, b, home, rows): members dealt to blocks of about ``block`` by a hash, home vectors first; ``rows`` are structs (rep, x, weight)."""
    own, guests = (F.ceil(F.col(c) / block) for c in ("homes", "others"))
    deal = F.xxhash64(F.lit("block"), "rep")
    b = F.when(F.col("home"), F.pmod(deal, own)).otherwise(own + F.pmod(deal, F.greatest(guests, F.lit(1))))
    each = placed.join(sizes.withColumn("others", F.col("members") - F.col("homes")), "cell").withColumn("b", b)
    return each.groupBy("cell", "b").agg(F.first("home").alias("home"), F.collect_list(F.struct("rep", "x", "weight")).alias("rows"))


def _unit(rows: list[bytes], width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    x = stack(rows, width, kind)
    return x, x / np.sqrt((x**2).sum(axis=1))[:, None]


def _distances(placed: DataFrame, large: DataFrame, kind: str, least: float, fan: int) -> DataFrame:
    """Members of large cells: (cell, rep, x, weight, home, q and d of the nearest pivot, others: the pivots whose cells it may be a guest of)."""
    inside = placed.join(large, "cell").select(placed.columns)
    first = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit("pivot"), "rep"), "rep")
    pivots = inside.where("home").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= fan).groupBy("cell").agg(F.collect_list("x").alias("pivots"))
    blocks = _packed(inside, large, 1024).join(store(pivots, "pivots"), "cell")
    reach, size = _reach(least), int(kind[1])

    def run(batch):
        out = {n: [] for n in ("cell", "rep", "x", "weight", "home", "q", "d", "others")}
        for cell, home, rows, around in zip(*(batch[n] for n in ("cell", "home", "rows", "pivots")), strict=True):
            width = max(len(r) for r in [*around, *(r["x"] for r in rows)]) // size
            x, p = _unit([r["x"] for r in rows], width, kind)[1], _unit(around, width, kind)[1]
            d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
            apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
            q = d.argmin(axis=1)
            nearest = d[np.arange(len(q)), q]
            with np.errstate(divide="ignore", invalid="ignore"):
                behind = (d**2 - nearest[:, None] ** 2) / (2 * apart[q])
            fits = (d <= nearest[:, None] + 2 * reach) & ~(behind > reach)
            if home:
                fits[np.arange(len(q)), q] = False
            for i, r in enumerate(rows):
                for n, value in (("cell", cell), ("rep", r["rep"]), ("x", r["x"]), ("weight", r["weight"]), ("home", home), ("q", int(q[i])), ("d", float(nearest[i])), ("others", [{"q": j, "d": float(d[i, j])} for j in np.flatnonzero(fits[i]).tolist()])):
                    out[n].append(value)
        return out

    schema = "cell string, rep long, x binary, weight long, home boolean, q int, d double, others array<struct<q:int,d:double>>"
    return arrow_map(blocks.select("cell", "home", "rows", "pivots"), schema, run, rows=1)


def _joined(placed: DataFrame, kind: str, least: float, block: int) -> DataFrame:
    """(rep, n, root) of each pair of blocks: a home vector's links there (by weight; guests 0), and the smallest vector of its part."""
    sizes = store(_sizes(placed), "sizes")
    size = int(kind[1])

    def pack(batch):
        out = {n: [] for n in ("cell", "b", "home", "ids", "weights", "width", "xs")}
        for cell, b, home, rows in zip(*(batch[n] for n in ("cell", "b", "home", "rows")), strict=True):
            width = max(len(r["x"]) for r in rows)
            packed = (np.array([r[n] for r in rows], np.int64).tobytes() for n in ("rep", "weight"))
            for n, value in zip(out, (cell, b, home, *packed, width // size, b"".join(r["x"].ljust(width, b"\0") for r in rows)), strict=True):
                out[n].append(value)
        return out

    blocks = store(arrow_map(_packed(placed, sizes, block), "cell string, b long, home boolean, ids binary, weights binary, width int, xs binary", pack, rows=1), "blocks")
    own = blocks.where("home").select("cell", F.col("b").alias("i"))
    pairs = own.join(blocks.select("cell", F.col("b").alias("j")), "cell").where("i <= j")
    side = lambda n: blocks.select("cell", F.col("b").alias(n), F.struct("home", "ids", "weights", "width", "xs").alias(f"of_{n}"))
    both = pairs.join(side("i"), ["cell", "i"]).join(side("j"), ["cell", "j"])

    def run(batch):
        out = {"rep": [], "n": [], "root": []}
        for a, b, same in zip(batch["of_i"], batch["of_j"], batch["same"], strict=True):
            for rep, n, root in _links(a, b, same, kind, least):
                out["rep"].append(rep)
                out["n"].append(n)
                out["root"].append(root)
        return out

    return arrow_map(both.select((F.col("i") == F.col("j")).alias("same"), "of_i", "of_j"), "rep long, n long, root long", run, rows=1)


def _links(a: dict, b: dict, same: bool, kind: str, least: float):
    """Of two blocks (or one with itself), (rep, links, smallest rep of its part) of the vectors with links; guests count none."""
    width = max(a["width"], b["width"])
    get = lambda s: (np.frombuffer(s["ids"], np.int64), np.frombuffer(s["weights"], np.int64), np.frombuffer(s["xs"], kind).reshape(-1, s["width"]).astype(np.float64))
    (a_ids, a_w, x), (b_ids, b_w, y) = get(a), get(b)
    x, y = np.pad(x, ((0, 0), (0, width - x.shape[1]))), np.pad(y, ((0, 0), (0, width - y.shape[1])))
    x_len, y_len = np.sqrt((x**2).sum(axis=1)), np.sqrt((y**2).sum(axis=1))
    near = (x / x_len[:, None]) @ (y / y_len[:, None]).T
    linked = near >= least
    for i, j in zip(*np.nonzero(np.abs(near - least) < 1e-9), strict=True):  # at the bound: by the plain formula
        linked[i, j] = float(x[i] @ y[j]) / (float(x_len[i]) * float(y_len[j])) >= least
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return
    low = np.full(len(a_ids), -1)
    for start in range(len(a_ids)):  # parts by breadth-first search over the rows
        if low[start] >= 0 or not linked[start].any():
            continue
        rows, front = np.zeros(len(a_ids), bool), np.zeros(len(a_ids), bool)
        front[start] = rows[start] = True
        columns = np.zeros(len(b_ids), bool)
        while front.any():
            reached = linked[front].any(axis=0) & ~columns
            columns |= reached
            front = linked[:, reached].any(axis=1) & ~rows
            rows |= front
        low[rows] = start
        root = int(min(a_ids[rows].min(), b_ids[columns].min()))
        for i in np.flatnonzero(rows).tolist():
            yield int(a_ids[i]), int(b_w[linked[i]].sum()), root
        for j in [] if same else np.flatnonzero(columns).tolist():  # a guest's links are counted in its home
            yield int(b_ids[j]), int(a_w[linked[:, j]].sum()) if b["home"] else 0, root
