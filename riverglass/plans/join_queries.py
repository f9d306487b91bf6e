"""Joins and set operations (family D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import query

WIDE = 2_000_000_000_000


@query("d1_fallback_join", "WITH r AS (SELECT user_id AS k, max(v) AS v FROM request WHERE event_type = 'click' GROUP BY 1), p AS (SELECT user_id AS k, min(v) AS v FROM request GROUP BY 1) SELECT coalesce(r.k, p.k) AS user_id, coalesce(r.v, p.v) AS v FROM r FULL JOIN p ON r.k = p.k")
def d1(d):
    recent = d.request.where("event_type = 'click'").groupBy("user_id").agg(F.max("v").alias("v"))
    return J.with_fallback(recent, d.request.groupBy("user_id").agg(F.min("v").alias("v")), ["user_id"], ["v"])


@query("d2_anti_join_batch", "WITH r AS (SELECT user_id AS k, max(v) AS v, count(*) AS n FROM request WHERE event_type = 'click' GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT user_id AS k, min(v) AS v, count(*) AS n FROM request GROUP BY 1) SELECT k, v, n FROM r UNION ALL SELECT k, v, n FROM p WHERE k NOT IN (SELECT k FROM r)")
def d2(d):
    recent = d.request.where("event_type = 'click'").groupBy(F.col("user_id").alias("k")).agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n"))
    profiled = d.request.groupBy(F.col("user_id").alias("k")).agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return J.fill_missing(recent, profiled, "k")


@query("d3_class_routing", "WITH e(dst, coi) AS (VALUES ('arcface', 0), ('carbrand', 2), ('platedet', 2), ('sink', -1)) SELECT dst, class_id, count(*) AS n FROM detections JOIN e ON class_id = coi OR coi = -1 GROUP BY ALL")
def d3(d):
    edges = d.spark.createDataFrame([("arcface", 0), ("carbrand", 2), ("platedet", 2), ("sink", -1)], "dst string, coi long")
    return J.route(d.detections, edges).groupBy("dst", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query("b26_class_of_interest", "WITH e(dst, coi) AS (VALUES ('arcface', 0), ('carbrand', 2), ('sink', -1)) SELECT dst, count(*) AS n FROM detections, e WHERE coi = -1 OR class_id = coi GROUP BY dst")
def b26(d):
    edges = d.spark.createDataFrame([("arcface", 0), ("carbrand", 2), ("sink", -1)], "dst string, coi long")
    return J.route(d.detections, edges).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


STEPS = "steps AS (SELECT user_id % 5 AS trace, t0 AS tm, max(v) AS mbps FROM request WHERE event_id % 7 = 0 GROUP BY ALL), pts AS (SELECT event_id, user_id % 5 AS trace, t0 AS tm FROM request)"


def _steps(d):
    steps = d.request.where("event_id % 7 = 0").groupBy((F.col("user_id") % 5).alias("trace"), F.col("t0").alias("tm")).agg(F.max("v").alias("mbps"))
    return d.request.select("event_id", (F.col("user_id") % 5).alias("trace"), F.col("t0").alias("tm")), steps


@query("d4_as_of_bandwidth", f"WITH {STEPS}, f AS (SELECT trace, arg_min(mbps, tm) AS mbps FROM steps GROUP BY trace) SELECT event_id, coalesce(s.mbps, f.mbps) AS mbps FROM pts ASOF LEFT JOIN steps s ON pts.trace = s.trace AND pts.tm >= s.tm LEFT JOIN f ON f.trace = pts.trace")
def d4(d):
    points, steps = _steps(d)
    return J.step_value(points, steps, ["trace"], "tm", "mbps", WIDE).select("event_id", "mbps")


@query("d5_nearest_join", f"WITH {STEPS}, b AS (SELECT event_id, pts.trace AS trace, pts.tm AS tm, s.mbps AS v0, s.tm AS a0 FROM pts ASOF LEFT JOIN steps s ON pts.trace = s.trace AND pts.tm >= s.tm), a AS (SELECT event_id, s.mbps AS v1, s.tm AS a1 FROM pts ASOF LEFT JOIN steps s ON pts.trace = s.trace AND pts.tm <= s.tm) SELECT event_id, CASE WHEN a0 IS NOT NULL AND (a1 IS NULL OR tm - a0 <= a1 - tm) THEN v0 ELSE v1 END AS mbps FROM b JOIN a USING (event_id)")
def d5(d):
    points, steps = _steps(d)
    return J.nearest(points, steps, ["trace"], "tm", "mbps", WIDE).select("event_id", "mbps")


@query("d6_positional_join", "WITH s AS (SELECT stream, sender_host, v, row_number() OVER (PARTITION BY stream, sender_host ORDER BY t0, event_id) AS i FROM request) SELECT a.stream, CAST(a.i AS BIGINT) AS i, a.v - b.v AS difference FROM s a JOIN s b ON a.stream = b.stream AND a.i = b.i WHERE a.sender_host = 'edge1' AND b.sender_host = 'edge0'")
def d6(d):
    r = d.request
    out = J.positional_difference(r.where("sender_host = 'edge1'"), r.where("sender_host = 'edge0'"), ["stream"], ["t0", "event_id"], "v")
    return out.select("stream", F.col("i").cast("long").alias("i"), "difference")


@query("d7_mean_by_position", "WITH s AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY t0, event_id) AS i FROM request) SELECT CAST(i AS BIGINT) AS i, CAST(sum(v) AS DOUBLE) / (SELECT count(DISTINCT user_id) FROM request) AS mean FROM s GROUP BY i")
def d7(d):
    return J.mean_by_position(d.request, "user_id", ["t0", "event_id"], "v", of_all=True).select(F.col("i").cast("long").alias("i"), "mean")


@query("d8_device_pairs", "WITH u AS (SELECT DISTINCT stream AS pipeline, CASE WHEN user_id % 3 = 0 THEN 'server' ELSE sender_host END AS sender FROM request), h AS (SELECT DISTINCT stream AS pipeline, CASE WHEN event_id % 2 = 0 THEN 'server' ELSE sender_host END AS receiver FROM request) SELECT pipeline, sender, receiver FROM u JOIN h USING (pipeline) WHERE NOT (sender = 'server' AND receiver <> 'server')")
def d8(d):
    pick = lambda cond, name: d.request.select(F.col("stream").alias("pipeline"), F.when(cond, "server").otherwise(F.col("sender_host")).alias(name)).distinct()
    return J.device_pairs(pick(F.col("user_id") % 3 == 0, "sender"), pick(F.col("event_id") % 2 == 0, "receiver"))


@query("d9_union", "SELECT stream, count(*) AS n, CAST(sum(late) AS BIGINT) AS late FROM (SELECT stream, late_requests AS late FROM arrival UNION ALL SELECT stream, NULL FROM process) GROUP BY stream")
def d9(d):
    both = d.arrival.select("stream", F.col("late_requests").alias("late")).unionByName(d.process.select("stream"), allowMissingColumns=True)
    return both.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("late"))


@query("d10_set_difference", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def d10(d):
    return d.customer.select("c_custkey").distinct().join(d.orders.where("o_orderkey % 10 = 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("d12_grid_join", "WITH g AS (SELECT user_id, day, sum(v) AS v FROM request GROUP BY ALL), m AS (SELECT DISTINCT user_id FROM g), n AS (SELECT DISTINCT day FROM g) SELECT user_id, day, CAST(coalesce(v, 0) AS BIGINT) AS v FROM m CROSS JOIN n LEFT JOIN g USING (user_id, day)")
def d12(d):
    return J.full_grid(d.request, "user_id", "day", "v").select("user_id", "day", "v")


@query("d13_distinct_by_priority", "SELECT user_id, stream, v FROM (SELECT user_id, stream, v, row_number() OVER (PARTITION BY user_id, stream ORDER BY v DESC, event_id) AS rn FROM request) WHERE rn = 1")
def d13(d):
    return J.first_of(d.request, ["user_id", "stream"], [F.desc("v"), F.col("event_id")]).select("user_id", "stream", "v")
