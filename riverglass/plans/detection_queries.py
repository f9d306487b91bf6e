"""Detection analytics (family F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection as D
from .registry import query

LAYOUT = "lay(idx, x, y, w, h) AS (VALUES (0, 0, 0, 159, 119), (1, 161, 0, 159, 119), (2, 0, 121, 159, 119), (3, 161, 121, 159, 119))"
OV = "greatest(least(x2, x + w) - greatest(x1, x), 0) * greatest(least(y2, y + h) - greatest(y1, y), 0)"
GT_IOU = "greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1) + {p}, 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1) + {p}, 0)"
AREA = "(({0}.x2 - {0}.x1 + {1}) * ({0}.y2 - {0}.y1 + {1}))"


def iou_sql(p: int) -> str:
    both = GT_IOU.format(p=p)
    return f"CAST({both} AS DOUBLE) / ({AREA.format('d', p)} + {AREA.format('g', p)} - {both})"


@query("f1_tile_layouts", "WITH n AS (SELECT det_id, sort_key, x1 % 5 AS num_imgs FROM detections), t AS (SELECT *, unnest(range(0, num_imgs)) AS idx, CASE WHEN num_imgs = 4 THEN 2 ELSE 1 END AS c, CASE WHEN num_imgs = 4 THEN 2 ELSE num_imgs END AS r FROM n), s AS (SELECT *, CAST((320 - 2 * (c - 1)) // c AS BIGINT) AS w, CAST((240 - 2 * (r - 1)) // r AS BIGINT) AS h FROM t) SELECT det_id, sort_key, num_imgs, idx, (idx % c) * (w + 2) AS x, (idx // c) * (h + 2) AS y, w, h FROM s")
def f1(d):
    rows = d.detections.select("det_id", "sort_key", (F.col("x1") % 5).alias("num_imgs"))  # 0 to 4 images share a frame
    return rows.select("*", F.inline(D.tile_layout(F.col("num_imgs"), 240, 320, pad=2)))


@query("f2_assign_tile", f"WITH {LAYOUT}, o AS (SELECT det_id, sort_key, idx, x1 - x AS x1, y1 - y AS y1, {OV} AS ov, row_number() OVER (PARTITION BY det_id, sort_key ORDER BY {OV} DESC, idx) AS rn FROM detections, lay WHERE {OV} > 0) SELECT det_id, sort_key, CAST(idx AS BIGINT) AS tile, x1, y1 FROM o WHERE rn = 1")
def f2(d):
    return D.assign_tile(d.detections, D.tile_layout(F.lit(4), 240, 320, pad=2)).select("det_id", "sort_key", "tile", "x1", "y1")


@query("f3_rescale", "SELECT det_id, sort_key, " + ", ".join(f"CAST(floor(greatest(0.0, least({top - 1}.0, {c} / 0.5::DOUBLE))) AS BIGINT) AS {c}" for c, top in (("x1", 640), ("y1", 480), ("x2", 640), ("y2", 480))) + " FROM detections")
def f3(d):
    return D.rescale(d.detections, 240, 320, 480, 640).select("det_id", "sort_key", *D.BOX)


@query("f4_drop_invalid", "SELECT det_id, sort_key FROM detections WHERE y2 - y1 > 19.2 AND x2 - x1 > 25.6 AND score >= 0.5")
def f4(d):
    return D.drop_small(d.detections, 1920, 2560).select("det_id", "sort_key")


@query("f5_image_counts", "SELECT det_id, sort_key, count(*) OVER (PARTITION BY image_id) AS n, CAST(row_number() OVER (PARTITION BY image_id ORDER BY det_id, sort_key) - 1 AS BIGINT) AS idx FROM detections")
def f5(d):
    from pyspark.sql import Window

    w = Window.partitionBy("image_id")
    return d.detections.select("det_id", "sort_key", F.count(F.lit(1)).over(w).alias("n"), (F.row_number().over(w.orderBy("det_id", "sort_key")) - 1).cast("long").alias("idx"))


@query("f6_class_counts", "SELECT image_id, class_id, count(*) AS n FROM detections GROUP BY ALL")
def f6(d):
    return d.detections.groupBy("image_id", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query("f7_portioned_fan_out", "SELECT det_id, sort_key, CASE WHEN (row_number() OVER (PARTITION BY image_id, class_id ORDER BY det_id, sort_key) - 1) / CAST(count(*) OVER (PARTITION BY image_id, class_id) AS DOUBLE) >= 0.6 THEN 1 ELSE 0 END::BIGINT AS target FROM detections")
def f7(d):
    return D.portioned(d.detections, ["image_id", "class_id"], ["det_id", "sort_key"], [0.6, 0.4]).select("det_id", "sort_key", "target")


@query("f8_byte_accounting", "SELECT image_id, class_id, CAST(sum((x2 - x1) * (y2 - y1) * 3) AS BIGINT) AS bytes FROM detections GROUP BY ALL")
def f8(d):
    return d.detections.groupBy("image_id", "class_id").agg(F.sum(D.area(D.BOX) * 3).alias("bytes"))


def _with_truth(d):
    truths = d.ground_truth.select("image_id", "gt_id", *[F.col(c).alias(f"g_{c}") for c in D.BOX])
    return d.detections.join(truths, "image_id"), tuple(f"g_{c}" for c in D.BOX)


JOINED = "FROM detections d JOIN ground_truth g ON d.image_id = g.image_id"


@query("f9_iou_pairs", f"SELECT d.det_id, d.sort_key, gt_id, {GT_IOU.format(p=0)} AS shared, round({iou_sql(0)}, 9) AS iou, round(CAST({GT_IOU.format(p=0)} AS DOUBLE) / {AREA.format('d', 0)}, 9) AS iof {JOINED}")
def f9(d):
    pairs, g = _with_truth(d)
    return pairs.select("det_id", "sort_key", "gt_id", D.overlap(D.BOX, g).alias("shared"), F.round(D.iou(D.BOX, g), 9).alias("iou"), F.round(D.iof(D.BOX, g), 9).alias("iof"))


@query("f10_iou_plus_one", f"SELECT d.det_id, d.sort_key, gt_id, round({iou_sql(1)}, 9) AS iou {JOINED}")
def f10(d):
    pairs, g = _with_truth(d)
    return pairs.select("det_id", "sort_key", "gt_id", F.round(D.iou(D.BOX, g, 1), 9).alias("iou"))


def nms_sql(threshold: float, plus: int, where: str = "TRUE", top: int | None = None, keep: int | None = None) -> str:
    """Greedy suppression as a recursion over each image's list of boxes in order: the first stays, what it covers goes."""
    size = lambda b: f"({b}.x2 - {b}.x1 + {plus}) * ({b}.y2 - {b}.y1 + {plus})"
    both = f"greatest(0, least(rest[1].x2, b.x2) - greatest(rest[1].x1, b.x1) + {plus}) * greatest(0, least(rest[1].y2, b.y2) - greatest(rest[1].y1, b.y1) + {plus})"
    goes_on = f"list_filter(rest[2:], lambda b: {both} <= {threshold}::DOUBLE * ({size('rest[1]')} + {size('b')} - {both}))"
    first = f"SELECT image_id, 1 AS n, list({{'d': det_id, 'k': sort_key, 's': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, det_id, sort_key){f'[:{top}]' if top else ''} AS rest FROM detections WHERE {where} GROUP BY image_id"
    limit = f" AND n <= {keep}" if keep else ""
    return f"WITH RECURSIVE s(image_id, n, rest) AS ({first} UNION ALL SELECT image_id, n + 1, {goes_on} FROM s WHERE len(rest) > 1) SELECT rest[1].d AS det_id, rest[1].k AS sort_key, rest[1].s AS score FROM s WHERE len(rest) > 0{limit}"


def _scored(d):
    """What suppression reads: no other column is shuffled or sorted with the boxes."""
    return d.detections.select("image_id", "det_id", "sort_key", "score", *D.BOX)


@query("f11_nms", nms_sql(0.4, 1))
def f11(d):
    return D.suppress(_scored(d), ["image_id"], 0.4, plus=1, order=("det_id", "sort_key")).select("det_id", "sort_key", "score")


@query("f12_nms_top_k", nms_sql(0.5, 0, top=200))
def f12(d):
    return D.suppress(_scored(d), ["image_id"], 0.5, top=200, order=("det_id", "sort_key")).select("det_id", "sort_key", "score")


@query("f13_filter_chain", nms_sql(0.4, 1, "score > 0.02", 5000, 750))
def f13(d):
    return D.filter_chain(_scored(d), "image_id", ("det_id", "sort_key"), 0.02, 5000, 0.4, 750).select("det_id", "sort_key", "score")


@query("f14_prior_boxes", "WITH m AS (SELECT DISTINCT image_id, 32 * (1 + image_id % 2) AS hh, 32 * (1 + image_id % 3) AS ww FROM detections), l(k, step, size, s) AS (VALUES (0, 32, 16, 0), (0, 32, 32, 1), (1, 64, 64, 0)), c AS (SELECT *, unnest(range(0, CAST(ceil(hh / step::DOUBLE) AS BIGINT))) AS i FROM m, l), g AS (SELECT *, unnest(range(0, CAST(ceil(ww / step::DOUBLE) AS BIGINT))) AS j FROM c) SELECT image_id, k, i::INT AS i, j::INT AS j, s, round((j + 0.5::DOUBLE) * step / ww, 9) AS cx, round((i + 0.5::DOUBLE) * step / hh, 9) AS cy, round(size / ww::DOUBLE, 9) AS w, round(size / hh::DOUBLE, 9) AS h FROM g")
def f14(d):
    images = d.detections.select("image_id").distinct()
    out = D.priors(images, 32 * (1 + F.col("image_id") % 2), 32 * (1 + F.col("image_id") % 3), [[16, 32], [64]], [32, 64])
    return out.select("image_id", "k", "i", "j", "s", *[F.round(c, 9).alias(c) for c in ("cx", "cy", "w", "h")])


def _on_priors(d):
    return d.detections.withColumns({"cx": F.lit(160.0), "cy": F.lit(120.0), "w": F.lit(64.0), "h": F.lit(48.0)})


@query("f15_encode_decode", "SELECT det_id, sort_key, round(((x1 + x2) / 2.0::DOUBLE - 160) / 6.4, 6) AS l0, round(ln((x2 - x1) / 64.0::DOUBLE) / 0.2, 6) AS l2, CAST(x1 AS DOUBLE) AS back_x1, CAST(y2 AS DOUBLE) AS back_y2 FROM detections")
def f15(d):
    out = D.decode(D.encode(_on_priors(d)))
    return out.select("det_id", "sort_key", F.round("l0", 6).alias("l0"), F.round("l2", 6).alias("l2"), F.round("d_x1", 6).alias("back_x1"), F.round("d_y2", 6).alias("back_y2"))


@query("f16_landmarks", "SELECT det_id, sort_key, round((x1 - 160) / 6.4::DOUBLE, 6) AS first_x, round((y2 - 120) / 4.8::DOUBLE, 6) AS last_y FROM detections")
def f16(d):
    points = F.array(*[F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x1", "y2"), ("x2", "y2"), ("x2", "y2"))])
    out = D.landmarks(_on_priors(d).withColumn("points", points), "points")
    return out.select("det_id", "sort_key", F.round(F.col("coded")[0]["x"], 6).alias("first_x"), F.round(F.col("coded")[4]["y"], 6).alias("last_y"))


def _prior_pairs(d):
    pairs, g = _with_truth(d)
    return pairs.select("image_id", (F.col("det_id") * 31 + F.col("sort_key")).alias("prior_id"), "gt_id", D.iou(D.BOX, g).alias("iou"))


PAIRS = f"prs AS (SELECT d.image_id, d.det_id * 31 + d.sort_key AS prior_id, gt_id, {iou_sql(0)} AS iou {JOINED})"
MATCH = f"""{PAIRS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, prior_id ORDER BY iou DESC, gt_id) AS rn FROM prs) WHERE rn = 1),
claim AS (SELECT image_id, prior_id, max(gt_id) AS forced FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gt_id ORDER BY iou DESC, prior_id) AS rn FROM prs) WHERE rn = 1 AND iou >= 0.2 GROUP BY ALL),
mt AS (SELECT b.image_id, b.prior_id, coalesce(forced, gt_id) AS gt_id, iou, CASE WHEN b.image_id IN (SELECT image_id FROM claim) AND (forced IS NOT NULL OR iou >= 0.35) THEN 1 ELSE 0 END AS label FROM best b LEFT JOIN claim c ON b.image_id = c.image_id AND b.prior_id = c.prior_id)"""


@query("f17_prior_matching", f"WITH {MATCH} SELECT image_id, prior_id, gt_id, label::BIGINT AS label FROM mt")
def f17(d):
    return D.match_priors(_prior_pairs(d)).select("image_id", "prior_id", "gt_id", "label")


@query("f18_hard_negatives", f"WITH {MATCH}, r AS (SELECT image_id, prior_id, label, prior_id % 997 AS loss, sum(label) OVER w AS pos, count(*) OVER w AS n FROM mt WINDOW w AS (PARTITION BY image_id)), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY loss DESC, prior_id) AS rank FROM r WHERE label = 0) SELECT image_id, prior_id, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= least(pos * 2, n - 1)")
def f18(d):
    rows = D.match_priors(_prior_pairs(d)).withColumn("loss", F.col("prior_id") % 997)
    return D.hard_negatives(rows, ratio=2).select("image_id", "prior_id", F.col("rank").cast("long").alias("rank"))


HITS = f"""pr AS (SELECT d.image_id, d.det_id, d.sort_key, d.score, g.gt_id, g.ignored, g.setting, {iou_sql(1)} AS iou {JOINED}),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, det_id, sort_key ORDER BY iou DESC, gt_id) AS rn FROM pr) WHERE rn = 1),
hit AS (SELECT *, iou >= 0.5 AND NOT ignored AND row_number() OVER (PARTITION BY image_id, gt_id, iou >= 0.5 ORDER BY score DESC, det_id, sort_key) = 1 AS is_hit, NOT (iou >= 0.5 AND ignored) AS counts FROM bst)"""
CURVE = f"{HITS}, cl AS (SELECT setting, least(CAST(floor((1 - score) * 1000) AS BIGINT), 999) AS cell, count(*) FILTER (counts) AS n, count(*) FILTER (is_hit) AS h FROM hit GROUP BY ALL), tr AS (SELECT setting, count(*) AS truths FROM ground_truth WHERE NOT ignored GROUP BY 1), cv AS (SELECT setting, cell, sum(n) OVER w AS proposals, sum(h) OVER w AS hits FROM cl WINDOW w AS (PARTITION BY setting ORDER BY cell)), pc AS (SELECT setting, cell, CAST(proposals AS BIGINT) AS proposals, CAST(hits AS BIGINT) AS hits, coalesce(hits / nullif(proposals, 0)::DOUBLE, 0) AS prec, hits / truths::DOUBLE AS rec FROM cv JOIN tr USING (setting))"


def _curve(d):
    settings = d.ground_truth.select("image_id", "setting").distinct()
    matched = D.recall_match(d.detections, d.ground_truth).join(settings, "image_id")
    truths = d.ground_truth.where("NOT ignored").groupBy("setting").agg(F.count(F.lit(1)).alias("truths"))
    return D.precision_recall(matched, truths, ["setting"])


@query("f19_recall_match", f"WITH {HITS} SELECT det_id, sort_key, is_hit, counts FROM hit")
def f19(d):
    return D.recall_match(d.detections, d.ground_truth).select("det_id", "sort_key", "is_hit", "counts")


@query("f20_pr_counts", f"WITH {CURVE} SELECT setting, cell, proposals, hits FROM pc")
def f20(d):
    return _curve(d).select("setting", "cell", "proposals", "hits")


AP = "round(sum((rec - coalesce(before, 0)) * env), 6) AS ap"
ENV = "SELECT *, max(prec) OVER (PARTITION BY setting ORDER BY cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, lag(rec) OVER (PARTITION BY setting ORDER BY cell) AS before FROM pc"


@query("f21_average_precision", f"WITH {CURVE} SELECT {AP} FROM ({ENV}) WHERE setting = 'easy'")
def f21(d):
    return D.average_precision(_curve(d).where("setting = 'easy'"), ["setting"]).select(F.round("ap", 6).alias("ap"))


@query("f22_ap_by_difficulty", f"WITH {CURVE} SELECT setting, {AP} FROM ({ENV}) GROUP BY setting")
def f22(d):
    return D.average_precision(_curve(d), ["setting"]).select("setting", F.round("ap", 6).alias("ap"))


@query("d11_spatial_overlap", "WITH p AS (SELECT a.det_id AS a, a.sort_key AS sa, b.det_id AS b, b.sort_key AS sb, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS shared FROM detections a JOIN detections b ON a.image_id = b.image_id AND (a.det_id, a.sort_key) < (b.det_id, b.sort_key)) SELECT a, sa, b, sb, shared FROM p WHERE shared > 0")
def d11(d):
    names = ("x1", "y1", "x2", "y2")
    a, b = (d.detections.select("image_id", F.col("det_id").alias(s), F.col("sort_key").alias(f"s{s}"), *[F.col(c).alias(f"{s}_{c}") for c in names]) for s in ("a", "b"))
    pairs = D.overlapping(a, b, "image_id", tuple(f"a_{c}" for c in names), tuple(f"b_{c}" for c in names))
    return pairs.where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("sa") < F.col("sb")))).select("a", "sa", "b", "sb", "shared")
