"""Detections as tables: tiles, overlap joins, suppression, matching and average precision. Pair joins always meet on the image."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def tile_layout(num_imgs: Column, height: int, width: int, pad: int = 0) -> Column:
    """Array of (idx, x, y, w, h): where each of 0 to 4 packed images stands: whole, stacked, or two by two."""
    n = num_imgs.cast("long")
    cols, rows = F.when(n == 4, 2).otherwise(1), F.when(n == 4, 2).otherwise(F.greatest(n, F.lit(1)))
    w, h = F.floor((width - pad * (cols - 1)) / cols), F.floor((height - pad * (rows - 1)) / rows)
    index = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    place = lambda i: {"idx": i, "x": (i % cols) * (w + pad), "y": F.floor(i / cols) * (h + pad), "w": w, "h": h}
    return F.transform(index, lambda i: F.struct(*[v.cast("long").alias(k) for k, v in place(i).items()]))


def overlap(a: tuple[str, ...], b: tuple[str, ...], plus: int = 0) -> Column:
    """Area that two boxes share."""
    side = lambda i, j: F.greatest(F.least(a[j], b[j]) - F.greatest(a[i], b[i]) + plus, F.lit(0))
    return side(0, 2) * side(1, 3)


def area(box: tuple[str, ...], plus: int = 0) -> Column:
    return (F.col(box[2]) - F.col(box[0]) + plus) * (F.col(box[3]) - F.col(box[1]) + plus)


def iou(a: tuple[str, ...], b: tuple[str, ...], plus: int = 0) -> Column:
    both = overlap(a, b, plus)
    return F.coalesce(F.try_divide(both.cast("double"), (area(a, plus) + area(b, plus) - both).cast("double")), F.lit(0.0))


def iof(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Share of the first box that the second covers."""
    return F.coalesce(F.try_divide(overlap(a, b).cast("double"), area(a).cast("double")), F.lit(0.0))


def overlapping(a: DataFrame, b: DataFrame, key: str, a_box: tuple[str, ...], b_box: tuple[str, ...], cell: int = 64) -> DataFrame:
    """Pairs of boxes of one ``key`` that share an area (column shared), met only in the cells of a grid that both cover.

    A pair that meets in several cells counts in the one that holds the left upper corner of what they share. In a crowded image a box meets its neighbourhood, not the image.
    """

    def gridded(df: DataFrame, box: tuple[str, ...]) -> DataFrame:
        steps = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
        real = (F.col(box[2]) > F.col(box[0])) & (F.col(box[3]) > F.col(box[1]))
        return df.where(real).withColumn("cx_", steps(box[0], box[2])).withColumn("cy_", steps(box[1], box[3]))

    pairs = gridded(a, a_box).join(gridded(b, b_box), [key, "cx_", "cy_"])
    corner = lambda i: F.floor(F.greatest(F.col(a_box[i]), F.col(b_box[i])) / cell)
    return pairs.withColumn("shared", overlap(a_box, b_box)).where((F.col("shared") > 0) & (F.col("cx_") == corner(0)) & (F.col("cy_") == corner(1))).drop("cx_", "cy_")


def assign_tile(detections: DataFrame, layout: Column) -> DataFrame:
    """Every detection in the tile it overlaps most (the first of equals), in the tile's coordinates; without overlap it is dropped.

    The choice is made row by row from the tiles of ``layout`` (see ``tile_layout``): no join, no shuffle, equal rows stay.
    """
    keys = [c for c in detections.columns if c not in BOX]
    side = lambda low, high, at, size: F.greatest(F.least(F.col(high), at + size) - F.greatest(F.col(low), at), F.lit(0))
    shared = F.transform(layout, lambda t: F.struct((side("x1", "x2", t["x"], t["w"]) * side("y1", "y2", t["y"], t["h"])).alias("shared"), (-t["idx"]).alias("first"), t["x"].alias("x"), t["y"].alias("y")))
    hit = detections.withColumn("tile_", F.array_max(shared)).where("tile_.shared > 0")
    return hit.select(*keys, (-F.col("tile_.first")).alias("tile"), *[(F.col(c) - F.col(f"tile_.{c[0]}")).alias(c) for c in BOX])


def rescale(df: DataFrame, infer_h: int, infer_w: int, height: int, width: int) -> DataFrame:
    """Boxes from inference size to the original image: one gain for both axes, clipped to the image, whole numbers."""
    gain = min(infer_h / height, infer_w / width)
    to = lambda c, top: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(top - 1.0), F.col(c) / gain))).cast("long")
    return df.withColumns({c: to(c, width if c[0] == "x" else height) for c in BOX})


def drop_small(df: DataFrame, height: int, width: int, least: float = 0.5) -> DataFrame:
    return df.where((F.col("y2") - F.col("y1") > 0.01 * height) & (F.col("x2") - F.col("x1") > 0.01 * width) & (F.col("score") >= least))


def portioned(df: DataFrame, keys: list[str], order: list[str], portions: list[float]) -> DataFrame:
    """Adds target: items of a group go to the targets in order, by cumulative portion of the group."""
    w = Window.partitionBy(*keys)
    share = (F.row_number().over(w.orderBy(*order)) - 1) / F.count(F.lit(1)).over(w)
    bounds = np.cumsum(portions)[:-1].tolist()
    return df.withColumn("target", sum((F.when(share >= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("long"))


def suppress(boxes: DataFrame, keys: list[str], threshold: float, plus: int = 0, top: int | None = None, order: tuple[str, ...] = (), keep: int | None = None) -> DataFrame:
    """Greedy non-maximum suppression per ``keys`` (score descending, then ``order``, nulls last); groups are the boxes of an image.

    ``top`` limits the boxes that enter, ``keep`` those that stay, as the detector's settings do. One shuffle and one sort; the images of a batch are
    suppressed side by side, a round for each box kept of the fullest. Of an image that goes on in the next batch only the kept boxes are held.
    """
    schema = boxes.schema
    names = [*keys, *BOX]

    def changes(column: pa.Array) -> np.ndarray:  # whether each value but the first differs from the one before it; null equals null
        a, b = column[1:], column[:-1]
        differ = pc.or_(pc.xor(a.is_null(), b.is_null()), pc.fill_null(pc.not_equal(a, b), False))
        return differ.to_numpy(zero_copy_only=False)

    def stays(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # whether boxes a leave each of b standing
        w = np.maximum(0, np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]) + plus)
        h = np.maximum(0, np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]) + plus)
        area = lambda x: (x[:, 2] - x[:, 0] + plus) * (x[:, 3] - x[:, 1] + plus)
        return w * h <= threshold * (area(a) + area(b) - w * h)

    def run(batches):
        last, seen, stay = None, 0, np.zeros((0, 4))  # the image that the batch before ended in: its key, boxes seen and boxes kept
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n) for n in names}
            starts = np.zeros(batch.num_rows, bool)
            for n in keys:
                starts[1:] |= changes(columns[n])
            now = [columns[n][0].as_py() for n in keys]
            same = last is not None and now == last
            starts[0] = True
            image = np.cumsum(starts) - 1
            first = np.flatnonzero(starts)
            place = np.arange(batch.num_rows) - first[image]
            if same:
                place[image == 0] += seen
            else:
                stay = np.zeros((0, 4))
            b = np.stack([np.asarray(columns[n].to_numpy(zero_copy_only=False), np.float64) for n in BOX], axis=1)
            on = place < top if top else np.ones(batch.num_rows, bool)
            at = np.flatnonzero(on)
            if keep is not None and len(stay) >= keep:
                at = at[image[at] > 0]
            old = np.searchsorted(image[at], 1)
            old, at = at[:old], at[old:]
            for a in stay:  # boxes kept of an earlier batch come first
                if not len(old):
                    break
                old = old[stays(a[None], b[old])]
            at = np.concatenate((old, at))
            kept, counts = [], np.zeros(len(first), np.int64)
            counts[0] = len(stay)
            while len(at):
                head = np.concatenate(([True], image[at[1:]] != image[at[:-1]]))
                leads = at[head]
                kept.append(leads)
                counts[image[leads]] += 1
                rest = ~head
                lead, at = np.repeat(leads, np.diff(np.append(np.flatnonzero(head), len(at))))[rest], at[rest]
                at = at[stays(b[lead], b[at])]
                if keep is not None:
                    at = at[counts[image[at]] < keep]
            kept = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
            tail = len(first) - 1
            stay = np.concatenate((stay if tail == 0 else np.zeros((0, 4)), b[kept[image[kept] == tail]]))
            last, seen = [columns[n][batch.num_rows - 1].as_py() for n in keys], int(place[-1]) + 1
            yield batch.take(pa.array(kept))

    by = [*keys, F.desc("score"), *map(F.asc_nulls_last, order)]
    return boxes.repartition(*keys).sortWithinPartitions(*by).mapInArrow(run, schema)


def filter_chain(boxes: DataFrame, key: str, order: tuple[str, ...], least: float, top: int, threshold: float, keep: int) -> DataFrame:
    """Score filter, best ``top``, suppression, best ``keep``: boxes are kept in order of score, so suppression ends at ``keep``."""
    return suppress(boxes.where(F.col("score") > least), [key], threshold, plus=1, top=top, order=order, keep=keep)


def priors(images: DataFrame, height: Column, width: Column, sizes: list[list[int]], steps: list[int], clip: bool = False) -> DataFrame:
    """Adds k, i, j, s, cx, cy, w, h: the prior boxes of every cell of every feature map of every image, relative to its size."""
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(step).alias("step"), F.array(*[F.lit(float(x)) for x in s]).alias("sizes")) for k, (step, s) in enumerate(zip(steps, sizes, strict=True))])
    out = images.withColumns({"h_": height, "w_": width}).select("*", F.inline(levels))
    for name, side in (("i", "h_"), ("j", "w_")):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), (F.ceil(F.col(side) / F.col("step")) - 1).cast("int"))))
    out = out.select(*images.columns, "h_", "w_", "k", "step", "i", "j", F.posexplode("sizes").alias("s", "size"))
    values = {"cx": (F.col("j") + 0.5) * F.col("step") / F.col("w_"), "cy": (F.col("i") + 0.5) * F.col("step") / F.col("h_"), "w": F.col("size") / F.col("w_"), "h": F.col("size") / F.col("h_")}
    return out.select(*images.columns, "k", "i", "j", "s", *[(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) if clip else v).alias(n) for n, v in values.items()])


def encode(df: DataFrame, v0: float = 0.1, v1: float = 0.2) -> DataFrame:
    """Adds l0..l3: offsets of box (x1, y1, x2, y2) from prior (cx, cy, w, h)."""
    c = F.col
    return df.withColumns({"l0": ((c("x1") + c("x2")) / 2 - c("cx")) / (v0 * c("w")), "l1": ((c("y1") + c("y2")) / 2 - c("cy")) / (v0 * c("h")), "l2": F.ln((c("x2") - c("x1")) / c("w")) / v1, "l3": F.ln((c("y2") - c("y1")) / c("h")) / v1})


def decode(df: DataFrame, v0: float = 0.1, v1: float = 0.2) -> DataFrame:
    """Adds d_x1..d_y2: the box of offsets l0..l3 from prior (cx, cy, w, h)."""
    c = F.col
    x, y, w, h = c("cx") + c("l0") * v0 * c("w"), c("cy") + c("l1") * v0 * c("h"), c("w") * F.exp(c("l2") * v1), c("h") * F.exp(c("l3") * v1)
    return df.withColumns({"d_x1": x - w / 2, "d_y1": y - h / 2, "d_x2": x + w / 2, "d_y2": y + h / 2})


def landmarks(df: DataFrame, points: str, v0: float = 0.1, invert: bool = False) -> DataFrame:
    """Adds coded: landmark points (array of x, y structs) as offsets from the prior, or back."""
    code = lambda v, centre, size: F.col(centre) + v * v0 * F.col(size) if invert else (v - F.col(centre)) / (v0 * F.col(size))
    return df.withColumn("coded", F.transform(points, lambda p: F.struct(code(p["x"], "cx", "w").alias("x"), code(p["y"], "cy", "h").alias("y"))))


def match_priors(pairs: DataFrame, threshold: float = 0.35, force: float = 0.2) -> DataFrame:
    """From (image_id, prior_id, gt_id, iou): (image_id, prior_id, gt_id, iou, label).

    Every prior takes its best truth; every truth with overlap ``force`` or more claims its best prior (the highest truth wins a contested one);
    the label is 0 below ``threshold``, and everywhere in an image without such a truth.
    """
    best = pairs.groupBy("image_id", "prior_id").agg(F.max_by(F.struct("gt_id", "iou"), F.struct("iou", -F.col("gt_id"))).alias("b"))
    claims = pairs.groupBy("image_id", "gt_id").agg(F.max_by(F.struct("prior_id", "iou"), F.struct("iou", -F.col("prior_id"))).alias("p")).where(F.col("p.iou") >= force)
    claims = claims.groupBy("image_id", F.col("p.prior_id").alias("prior_id")).agg(F.max("gt_id").alias("forced"))
    images = claims.select("image_id", F.lit(True).alias("any_")).distinct()
    out = best.join(claims, ["image_id", "prior_id"], "left").join(images, "image_id", "left")
    gt = F.coalesce("forced", F.col("b.gt_id"))
    ok = F.coalesce("any_", F.lit(False)) & (F.col("forced").isNotNull() | (F.col("b.iou") >= threshold))
    return out.select("image_id", "prior_id", gt.alias("gt_id"), F.col("b.iou").alias("iou"), F.when(ok, 1).otherwise(0).cast("long").alias("label"))


def hard_negatives(df: DataFrame, ratio: int = 7) -> DataFrame:
    """Background rows (label 0) of the largest loss, up to ``ratio`` times the image's positives and all but one of its rows."""
    w = Window.partitionBy("image_id")
    rows = df.withColumns({"pos_": F.sum("label").over(w), "all_": F.count(F.lit(1)).over(w)}).where("label = 0")
    rank = F.row_number().over(w.orderBy(F.desc("loss"), "prior_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.least(F.col("pos_") * ratio, F.col("all_") - 1)).drop("pos_", "all_")


def recall_match(detections: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Detections (image_id, det_id, score) by score: is_hit if first to reach its best truth, counts if it is a proposal at all.

    A detection's best truth is that of the largest overlap. One whose best truth is ignored counts for nothing.
    """
    t = truths.select("image_id", "gt_id", "ignored", *[F.col(c).alias(f"g_{c}") for c in BOX])
    shared = iou(BOX, tuple(f"g_{c}" for c in BOX), plus=1)
    pairs = detections.join(t, "image_id").withColumn("iou_", shared)
    best = pairs.groupBy("image_id", "det_id", "sort_key", "score").agg(F.max_by(F.struct("gt_id", "ignored", "iou_"), F.struct("iou_", -F.col("gt_id"))).alias("b"))
    reach = F.col("b.iou_") >= threshold
    first = F.row_number().over(Window.partitionBy("image_id", "b.gt_id", reach).orderBy(F.desc("score"), "det_id", "sort_key")) == 1
    return best.select("image_id", "det_id", "sort_key", "score", (reach & ~F.col("b.ignored") & first).alias("is_hit"), (~(reach & F.col("b.ignored"))).alias("counts"))


def precision_recall(matched: DataFrame, truths: int | DataFrame, keys: list[str], grid: int = 1000) -> DataFrame:
    """proposals, hits, precision and recall at every threshold of a grid over the scores.

    A score falls into one cell of the grid; running sums from the top give the counts at each threshold, without a row per (score, threshold).
    """
    cell = F.least(F.floor((1 - F.col("score")) * grid), F.lit(grid - 1)).cast("long")
    counts = matched.groupBy(*keys, cell.alias("cell")).agg(F.count_if("counts").alias("n"), F.count_if("is_hit").alias("h"))
    upto = Window.partitionBy(*keys).orderBy("cell")
    out = counts.select(*keys, "cell", F.sum("n").over(upto).alias("proposals"), F.sum("h").over(upto).alias("hits"))
    out = out.join(truths, keys) if isinstance(truths, DataFrame) else out.withColumn("truths", F.lit(truths))
    return out.withColumns({"precision": F.coalesce(F.try_divide("hits", "proposals"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("hits", "truths"), F.lit(0.0))})


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the envelope of precision over recall, one row of the curve per recall step."""
    w = Window.partitionBy(*keys).orderBy("cell")
    envelope = F.max("precision").over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.coalesce(F.lag("recall").over(w), F.lit(0.0))
    return curve.select(*keys, ((F.col("recall") - before) * envelope).alias("part")).groupBy(*keys).agg(F.sum("part").alias("ap"))
