"""Batching and sampling (family G)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import batching as G
from .registry import query

K, O = ["user_id"], ["t0", "event_id"]
RN = "row_number() OVER (PARTITION BY user_id ORDER BY t0, event_id) - 1"


@query("g1_fixed_batches", f"SELECT event_id, CAST(rn // 8 AS BIGINT) AS batch, (rn // 8 + 1) * 8 <= n AS is_full FROM (SELECT event_id, {RN} AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM request)")
def g1(d):
    return G.fixed_batches(d.request, K, O, 8).select("event_id", "batch", "is_full")


WAIT = 20_000_000_000


TIMED_SQL = f"""WITH RECURSIVE o AS (SELECT event_id, user_id, t0, row_number() OVER (PARTITION BY user_id ORDER BY t0, event_id) AS rn FROM request),
b(event_id, user_id, rn, batch, start, fill) AS (SELECT event_id, user_id, rn, 0::BIGINT, t0, 1 FROM o WHERE rn = 1
UNION ALL SELECT o.event_id, o.user_id, o.rn, CASE WHEN fill >= 8 OR t0 - start > {WAIT} THEN batch + 1 ELSE batch END, CASE WHEN fill >= 8 OR t0 - start > {WAIT} THEN t0 ELSE start END, CASE WHEN fill >= 8 OR t0 - start > {WAIT} THEN 1 ELSE fill + 1 END FROM b JOIN o ON o.user_id = b.user_id AND o.rn = b.rn + 1)
SELECT event_id, batch FROM b"""


@query("g2_timed_batches", TIMED_SQL)
def g2(d):
    return G.timed_batches(d.request.select("event_id", "user_id", "t0"), K, "t0", "event_id", 8, WAIT).select("event_id", "batch")


@query("g3_batch_deadline", f"SELECT event_id, round(slo * 1000 - (t4 - t0) - (300 + v % 89) * fill * 1.2 - 40 * 1.2, 6)::DOUBLE AS left_us FROM (SELECT *, 1 + ({RN}) % 8 AS fill FROM request)")
def g3(d):
    rows = G.fixed_batches(d.request, K, O, 8)
    from pyspark.sql import Window

    fill = F.row_number().over(Window.partitionBy(*K, "batch").orderBy(*O))
    left = G.deadline(F.col("slo") * 1000, F.col("t4") - F.col("t0"), F.lit(40), F.lit(300), F.col("v") % 89, fill)
    return rows.select("event_id", F.round(left.cast("double"), 6).alias("left_us"))


@query("g4_frame_packing", f"SELECT event_id, CAST(rn // 4 AS BIGINT) AS frame, CAST(rn // 4 * 4 AS BIGINT) AS first_image FROM (SELECT event_id, {RN} AS rn FROM request)")
def g4(d):
    return G.frame_packing(d.request, K, O, 4).select("event_id", "frame", "first_image")


@query("g5_batch_statistics", f"SELECT user_id, count(*) AS batches, CAST(sum(n) AS BIGINT) AS items, avg(n) AS mean_size FROM (SELECT user_id, rn // 8 AS batch, count(*) AS n FROM (SELECT user_id, {RN} AS rn FROM request) GROUP BY ALL) GROUP BY user_id")
def g5(d):
    return G.batch_statistics(G.fixed_batches(d.request, K, O, 8), K)


SEGMENT = "SELECT event_id, user_id, t0, CAST(sum(CASE WHEN f < p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t0, event_id) AS BIGINT) AS segment FROM (SELECT *, v % 100 AS f, lag(v % 100) OVER (PARTITION BY user_id ORDER BY t0, event_id) AS p FROM request)"


@query("g6_run_segments", f"SELECT event_id, segment FROM ({SEGMENT})")
def g6(d):
    return G.run_segments(d.request.withColumn("frame", F.col("v") % 100), K, O, "frame").select("event_id", "segment")


@query("g7_warm_up", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY stream ORDER BY t0, event_id) - 1 AS rn FROM request) WHERE rn // 8 >= CASE WHEN 2 * 8 >= 120 THEN 2 ELSE 120 // 8 + 1 END")
def g7(d):
    return G.after_warm_up(d.request.select("event_id", "stream", "t0"), ["stream"], O, 8, configured=2).select("event_id")


@query("g8_trim_streams", f"SELECT event_id FROM (SELECT event_id, {RN} AS rn FROM request) WHERE rn < (SELECT min(n) FROM (SELECT count(*) AS n FROM request GROUP BY user_id))")
def g8(d):
    rows = G.frame_packing(d.request, K, O, 1)
    return G.trim_to_shortest(rows, "user_id", "frame").select("event_id")


def projection(x: np.ndarray) -> np.ndarray:
    """A fixed linear scorer of three classes: sums of every third component."""
    return np.stack([x[:, i::3].sum(axis=1) for i in range(3)], axis=1)


@query("g9_batch_scoring", "WITH s AS (SELECT vec_id, list_sum(list_filter(x, lambda e, i: i % 3 = 1)) AS a, list_sum(list_filter(x, lambda e, i: i % 3 = 2)) AS b, list_sum(list_filter(x, lambda e, i: i % 3 = 0)) AS c FROM (SELECT vec_id, list_transform(x, lambda e: CAST(e AS DOUBLE)) AS x FROM logits)) SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END::BIGINT AS label FROM s")
def g9(d):
    return G.score_batches(d.logits.select("vec_id", F.col("x").cast("array<double>").alias("x")), "x", projection).select("vec_id", "label")


@query("g10_mini_batches", "SELECT event_id, CAST((row_number() OVER (PARTITION BY agent ORDER BY md5('0:1:' || event_id), event_id) - 1) // 64 AS BIGINT) AS block FROM (SELECT agent, step AS event_id FROM trajectory)")
def g10(d):
    return G.mini_batches(d.trajectory.select("agent", "step"), ["agent"], "step", epoch=1).select(F.col("step").alias("event_id"), "block")
