"""Profile queries (family E, first half)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import PERIODS
from ..operators import profiles as E
from .registry import query
from .scalar_queries import recent

FIVE_DAYS = 5 * 86_400_000_000
G_SUM = "greatest(" + ", ".join(f"sum(arrival_rate_{p}s)" for p in PERIODS) + ")"
G_CV = "greatest(" + ", ".join(f"avg(coeff_var_{p}s)" for p in PERIODS) + ")"
G_ROW = "greatest(" + ", ".join(f"arrival_rate_{p}s" for p in PERIODS) + ")"
G_CVROW = "greatest(" + ", ".join(f"coeff_var_{p}s" for p in PERIODS) + ")"
NEW = f"timestamps >= (SELECT max(timestamps) FROM arrival) - {FIVE_DAYS}"
E1 = f"""WITH r AS (SELECT stream, model_name, round({G_SUM}, 6) AS rate, round({G_CV}, 6) AS cv FROM arrival WHERE {NEW} AND model_name <> 'signup' GROUP BY ALL),
p AS (SELECT stream, model_name, round(avg({G_ROW}), 6) AS rate, round(avg({G_CVROW}), 6) AS cv FROM arrival GROUP BY ALL)
SELECT stream, model_name, coalesce(r.rate, p.rate) AS rate, coalesce(r.cv, p.cv) AS cv FROM p FULL JOIN r USING (stream, model_name)"""


def _e1(d):
    a = d.arrival
    out = E.arrival_rate_cv(recent(a, "timestamps", FIVE_DAYS).where("model_name <> 'signup'"), a, ["stream", "model_name"])
    return out.select("stream", "model_name", F.round("rate", 6).alias("rate"), F.round("cv", 6).alias("cv"))


@query("e1_arrival_rate_cv", E1)
def e1(d):
    return _e1(d)


@query("e2_arrival_rate", f"SELECT stream, model_name, rate FROM ({E1})")
def e2(d):
    return _e1(d).select("stream", "model_name", "rate")


_HOST = "CASE {0} WHEN 'edge1' THEN 'server' ELSE {0} END".format
#: Arrivals of links: one host is the server, views are the detector's, whose model depends on the stream. Rows of the last five days are recent
#: where neither the sender is edge2 nor the receiver the server; all older ones are profiled.
ARR = {
    "stream": "stream", "sender": _HOST("sender_host"), "receiver": _HOST("receiver_host"), "timestamps": "timestamps", "event_id": "event_id",
    "receiver_type": "CASE receiver_host WHEN 'edge0' THEN 'nx' WHEN 'edge1' THEN 'serv' ELSE 'agx' END", "task": "CASE model_name WHEN 'view' THEN 'yolov5n' ELSE model_name END",
    "model": "CASE WHEN model_name <> 'view' THEN model_name WHEN stream = 'stream0' THEN 'yolov5n_320' WHEN stream = 'stream1' THEN 'yolov5n_512' ELSE 'yolov5n_640' END",
    "max_rate": G_ROW, "took": "p95_transfer_duration_us", "of_size": "1000 + p95_queueing_duration_us % 40 * 100", **{c: c for c in E.NETWORK},
}
ARR_SQL = f"""arr AS (SELECT {', '.join(f'{e} AS {n}' for n, e in ARR.items())} FROM arrival), newer AS (SELECT *, timestamps >= (SELECT max(timestamps) FROM arr) - {FIVE_DAYS} AS late FROM arr),
recent AS (SELECT * FROM newer WHERE late AND sender <> 'edge2' AND receiver <> 'server'), profiled AS (SELECT * FROM newer WHERE NOT late),
ent AS (SELECT sender, receiver, of_size AS pkg_size, quantile_disc(took, 0.95) AS latency FROM arr WHERE took <= 10000000 GROUP BY ALL),
steps AS (SELECT *, lead(pkg_size) OVER w AS ns, lead(latency) OVER w AS nl, first_value(latency) OVER w AS fl FROM ent WINDOW w AS (PARTITION BY sender, receiver ORDER BY pkg_size)),
firsts AS (SELECT sender, receiver, arg_min(latency, pkg_size) AS fl FROM ent GROUP BY ALL)"""
LATENCY = "CASE WHEN p_size IS NULL THEN NULL WHEN s.pkg_size IS NULL THEN f.fl WHEN ns IS NULL OR p_size <= s.pkg_size THEN s.latency ELSE greatest(s.latency, nl) END"
ESTIMATED = "FROM sized z ASOF LEFT JOIN steps s ON z.sender = s.sender AND z.receiver = s.receiver AND z.p_size >= s.pkg_size LEFT JOIN firsts f ON z.sender = f.sender AND z.receiver = f.receiver"


def _newest(table: str, keys: str, rows: int, agg: str, names: tuple[str, ...]) -> str:
    columns = ", ".join(agg.format(E.SHORT[n]) + f" AS {n}" for n in names)
    return f"(SELECT {keys}, {columns}, true AS has FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY timestamps DESC, event_id DESC) AS rn FROM {table}) WHERE rn <= {rows} GROUP BY {keys})"


def _links(d):
    rates = [f"arrival_rate_{p}s" for p in PERIODS]
    arr = d.arrival.selectExpr(*[f"{e} AS {n}" for n, e in ARR.items() if n != "max_rate"], *rates)
    last = recent(arr, "timestamps", FIVE_DAYS)
    before = arr.agg(F.max("timestamps")).first()[0] or 0
    return arr, last.where("sender <> 'edge2' AND receiver <> 'server'"), arr.where(F.col("timestamps") < before - FIVE_DAYS), E.network_entries(arr, "of_size", "took", keys=["sender", "receiver"])


@query(
    "e3_network_profile",
    f"""WITH {ARR_SQL}, links AS (SELECT DISTINCT stream, sender, receiver, receiver_type, task, model FROM arr),
    sized AS (SELECT l.*, r.has AS r_has, r.out_queue AS r_out_queue, r.transfer AS r_transfer, r.queue AS r_queue, r.size AS r_size, p.has AS p_has, p.out_queue AS p_out_queue, p.queue AS p_queue,
      CASE WHEN task LIKE '%yolo%' AND p.has THEN CASE WHEN model LIKE '%320%' THEN 307200 WHEN model LIKE '%512%' THEN 786432 ELSE 1228800 END ELSE p.size END AS p_size
      FROM links l LEFT JOIN {_newest('recent', 'stream, sender, receiver', 100, 'max({0})', tuple(E.SHORT))} r USING (stream, sender, receiver) LEFT JOIN {_newest('profiled', 'receiver_type, model', 100, 'max({0})', ('out_queue', 'queue', 'size'))} p USING (receiver_type, model))
    SELECT z.stream, z.sender, z.receiver, z.receiver_type, z.task, z.model, CASE WHEN r_has THEN r_out_queue ELSE p_out_queue END AS out_queue, CASE WHEN r_has THEN r_queue ELSE p_queue END AS queue, CASE WHEN r_has THEN r_size ELSE p_size END AS size,
      CASE WHEN r_has THEN r_transfer WHEN p_has AND task LIKE '%yolo%' AND z.sender <> 'server' AND z.sender = z.receiver THEN 0 ELSE {LATENCY} END AS transfer {ESTIMATED}""",
)
def e3(d):
    arr, now, then, entries = _links(d)
    links = arr.select("stream", "sender", "receiver", "receiver_type", "task", "model").distinct()
    return E.network_profile(links, now, then, entries)


@query(
    "e4_model_arrival_profile",
    f"""WITH {ARR_SQL}, links AS (SELECT DISTINCT stream, sender, receiver, model FROM arr),
    sized AS (SELECT l.*, rr.rate AS r_rate, pr.rate AS p_rate, r.has AS r_has, r.out_queue AS r_out_queue, r.transfer AS r_transfer, r.queue AS r_queue, r.size AS r_size, p.out_queue AS p_out_queue, p.queue AS p_queue, p.size AS p_size
      FROM links l LEFT JOIN (SELECT stream, arg_max(max_rate, (timestamps, event_id)) AS rate FROM recent WHERE stream <> 'stream3' GROUP BY stream) rr USING (stream)
      LEFT JOIN (SELECT model, max(max_rate) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY timestamps DESC, event_id DESC) AS rn FROM profiled) WHERE rn <= 10 GROUP BY model) pr USING (model)
      LEFT JOIN {_newest("(SELECT * FROM recent WHERE stream <> 'stream3')", 'stream, sender, receiver', 100, 'quantile_disc({0}, 0.95)', tuple(E.SHORT))} r USING (stream, sender, receiver) LEFT JOIN {_newest('profiled', 'receiver, model', 100, 'quantile_disc({0}, 0.95)', ('out_queue', 'queue', 'size'))} p USING (receiver, model))
    SELECT z.stream, z.sender, z.receiver, z.model, coalesce(r_rate, p_rate) AS rate, CASE WHEN r_has THEN r_out_queue ELSE p_out_queue END AS out_queue, CASE WHEN r_has THEN r_queue ELSE p_queue END AS queue, CASE WHEN r_has THEN r_size ELSE p_size END AS size,
      CASE WHEN r_has THEN r_transfer ELSE {LATENCY} END AS transfer {ESTIMATED}""",
)
def e4(d):
    arr, now, then, entries = _links(d)
    now = now.where("stream <> 'stream3'")  # one stream has no recent rate
    return E.arrival_profile(arr.select("stream", "sender", "receiver", "model").distinct(), now, then, entries)


Q = "CAST(quantile_disc(p95_{0}_duration_us, 0.95) AS DOUBLE)".format
E5 = f"""WITH r AS (SELECT device, model_name, infer_batch_size, {Q('prep')} AS prep, {Q('infer')} AS infer, {Q('post')} AS post FROM process WHERE timestamps >= (SELECT max(timestamps) FROM process) - {FIVE_DAYS} AND model_name <> 'click' GROUP BY ALL HAVING count(*) >= 3),
p AS (SELECT device, model_name, infer_batch_size, {Q('prep')} AS prep, {Q('infer')} / infer_batch_size * 1.005::DOUBLE AS infer, {Q('post')} AS post FROM process GROUP BY device, model_name, infer_batch_size)
SELECT * FROM r UNION ALL SELECT p.* FROM p ANTI JOIN r USING (device, model_name, infer_batch_size)"""


@query("e5_pre_post_latency", E5)
def e5(d):
    now = recent(d.process, "timestamps", FIVE_DAYS).where("model_name <> 'click'")
    return E.pre_post_latency(now, d.process, ["device", "model_name"])


@query("e6_batch_infer_latency", "SELECT device, infer_batch_size, CAST(quantile_disc(p95_infer_duration_us, 0.95) AS DOUBLE) / infer_batch_size AS infer FROM process GROUP BY device, infer_batch_size")
def e6(d):
    return E.batch_infer_latency(d.process, ["device"])


RES = ", ".join(f"max({c}) AS {c}" for c in ("cpu_usage", "mem_usage", "rss_mem_usage", "gpu_usage", "gpu_mem_usage"))


@query("e7_resource_requirements", f"SELECT system, batch_size, {RES} FROM hw GROUP BY ALL")
def e7(d):
    return E.resource_requirements(d.hw, ["system"])


ENT = "ent AS (SELECT sender_host, 1000 + v % 40 * 100 AS pkg_size, quantile_disc(t2 - t1, 0.95) AS latency FROM request WHERE t2 - t1 <= 10000000 GROUP BY ALL)"


def _entries(d):
    rows = d.request.select("sender_host", (1000 + F.col("v") % 40 * 100).alias("size"), (F.col("t2") - F.col("t1")).alias("took"))
    return E.network_entries(rows, "size", "took", keys=["sender_host"])


@query("e8_estimate_latency", f"WITH {ENT}, s AS (SELECT *, lead(pkg_size) OVER w AS ns, lead(latency) OVER w AS nl FROM ent WINDOW w AS (PARTITION BY sender_host ORDER BY pkg_size)), f AS (SELECT sender_host, arg_min(latency, pkg_size) AS fl FROM ent GROUP BY 1), q AS (SELECT event_id, sender_host, 500 + v % 6000 AS size FROM request), a AS (SELECT event_id, size, q.sender_host, s.* EXCLUDE (sender_host) FROM q ASOF LEFT JOIN s ON q.sender_host = s.sender_host AND q.size >= s.pkg_size) SELECT event_id, size, CASE WHEN pkg_size IS NULL THEN fl WHEN ns IS NULL OR size <= pkg_size THEN latency ELSE greatest(latency, nl) END AS latency FROM a JOIN f USING (sender_host)")
def e8(d):
    sizes = d.request.select("event_id", "sender_host", (500 + F.col("v") % 6000).alias("size"))
    return E.estimate_latency(sizes, _entries(d), "size", keys=["sender_host"]).drop("sender_host")


@query("e9_network_entries", f"WITH {ENT} SELECT * FROM ent")
def e9(d):
    return _entries(d)


@query("e10_full_profile", f"WITH a AS (SELECT infer_batch_size AS batch_size, {Q('prep')} AS prep, {Q('infer')} AS infer FROM process WHERE infer_batch_size <= 3 GROUP BY ALL), b AS (SELECT infer_batch_size AS batch_size, CAST(quantile_disc(p95_infer_duration_us, 0.95) AS DOUBLE) / infer_batch_size AS infer_b FROM process GROUP BY infer_batch_size), h AS (SELECT CAST(batch_size AS BIGINT) AS batch_size, max(cpu_usage) AS cpu, max(mem_usage) AS mem FROM hw GROUP BY ALL), j AS (SELECT batch_size, prep, coalesce(infer, infer_b) AS infer, cpu, mem FROM a FULL JOIN b USING (batch_size) FULL JOIN h USING (batch_size)) SELECT *, (SELECT max(batch_size) FROM j) AS max_batch FROM j")
def e10(d):
    p95 = lambda s: E.nearest_rank(f"p95_{s}_duration_us").cast("double").alias(s)
    size = F.col("infer_batch_size").alias("batch_size")
    prep = d.process.where("infer_batch_size <= 3").groupBy(size).agg(p95("prep"), p95("infer"))
    batch = E.batch_infer_latency(d.process, []).withColumnRenamed("infer_batch_size", "batch_size")
    hw = d.hw.groupBy(F.col("batch_size").cast("long").alias("batch_size")).agg(F.max("cpu_usage").alias("cpu"), F.max("mem_usage").alias("mem"))
    return E.full_profile(prep, batch, hw)


@query("e11_representative_latency", "WITH e AS (SELECT stream, 1000 + v % 40 * 100 AS pkg_size, quantile_disc(t2 - t1, 0.95) AS latency FROM request GROUP BY ALL), m AS (SELECT stream, (min(pkg_size) + max(pkg_size)) / 2.0 AS mid FROM e GROUP BY stream) SELECT stream, coalesce(arg_min(latency, pkg_size) FILTER (pkg_size >= mid), 0) AS latency FROM e JOIN m USING (stream) GROUP BY stream")
def e11(d):
    e = d.request.groupBy("stream", (1000 + F.col("v") % 40 * 100).alias("pkg_size")).agg(E.nearest_rank("t2 - t1").cast("long").alias("latency"))
    return E.representative_latency(e, ["stream"])


@query("e12_latency_history", "SELECT event_id, list(v) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent FROM request")
def e12(d):
    return E.history(d.request, ["user_id"], ["t0", "event_id"], "v", 5).select("event_id", F.col("window").alias("recent"))


@query("e13_training_batches", "WITH w AS (SELECT event_id, row_number() OVER u AS rn, lead(v) OVER u AS y FROM request WINDOW u AS (PARTITION BY user_id ORDER BY t0, event_id)) SELECT event_id, y, CAST((row_number() OVER (ORDER BY md5('7:' || event_id), event_id) - 1) // 64 AS BIGINT) AS batch FROM w WHERE rn >= 10 AND y IS NOT NULL")
def e13_batches(d):
    windows = E.supervised(d.request, ["user_id"], ["t0", "event_id"], "v", 10)
    return E.training_batches(windows.select("event_id", "x", "y"), "event_id", seed=7).select("event_id", "y", "batch")


@query("e13_supervised_windows", "SELECT user_id, event_id, list_sum(x)::BIGINT AS x_sum, y FROM (SELECT user_id, event_id, list(v) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x, lead(v) OVER (PARTITION BY user_id ORDER BY t0, event_id) AS y FROM request) WHERE len(x) = 10 AND y IS NOT NULL")
def e13(d):
    out = E.supervised(d.request, ["user_id"], ["t0", "event_id"], "v", 10)
    return out.select("user_id", "event_id", F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v).alias("x_sum"), "y")
