"""Capacity analytics (family E, second half)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capacity as C
from .registry import query

#: The traffic pipeline of the fixtures: edge and class of interest.
EDGES = [("datasource", "yolov5n", -1), ("yolov5n", "retina1face", 0), ("yolov5n", "carbrand", 2), ("yolov5n", "platedet", 2), ("retina1face", "arcface", -1), ("retina1face", "gender", -1), ("carbrand", "sink", -1), ("platedet", "sink", -1), ("arcface", "sink", -1), ("gender", "sink", -1)]
NODES = sorted({n for s, t, _ in EDGES for n in (s, t)})
E_SQL = "ed(src, dst, coi) AS (VALUES " + ", ".join(f"('{s}', '{t}', {c})" for s, t, c in EDGES) + ")"
N_SQL = "nm(i, node) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NODES)) + ")"
#: Every stream is a pipeline; a node's figures come from the requests of that stream whose id leaves the node's number.
NODE_SQL = f"{E_SQL}, {N_SQL}, nodes AS (SELECT stream AS pipeline, node, CAST(max(v) % 997 AS DOUBLE) AS max_proc, CAST(max(t2 - t1) AS DOUBLE) AS transfer, CAST(max(t0 % 89) AS DOUBLE) AS queue, CASE WHEN max(v) % 3 = 0 THEN 'server' ELSE 'edge' END AS device, max(v) % 700 AS input_size, min(t1 % 500) AS output_size, max(v) % 5 < 4 AS allowed, CAST(max(v) % 1501 AS DOUBLE) AS edge_proc, CAST(max(t1 - t0) % 61 AS DOUBLE) AS edge_transfer FROM request JOIN nm ON event_id % {len(NODES)} = i GROUP BY ALL), edges AS (SELECT DISTINCT pipeline, src, dst FROM nodes, ed)"


def _dag(d):
    names = d.spark.createDataFrame(list(enumerate(NODES)), "i long, node string")
    rows = d.request.withColumn("i", F.col("event_id") % len(NODES)).join(F.broadcast(names), "i")  # as many rows as the pipeline has nodes
    v = F.max("v")
    nodes = rows.groupBy(F.col("stream").alias("pipeline"), "node").agg(
        (v % 997).cast("double").alias("max_proc"), F.max(F.col("t2") - F.col("t1")).cast("double").alias("transfer"), F.max(F.col("t0") % 89).cast("double").alias("queue"),
        F.when(v % 3 == 0, "server").otherwise("edge").alias("device"), (v % 700).alias("input_size"), F.min(F.col("t1") % 500).alias("output_size"), (v % 5 < 4).alias("allowed"),
        (v % 1501).cast("double").alias("edge_proc"), (F.max(F.col("t1") - F.col("t0")) % 61).cast("double").alias("edge_transfer"),
    )
    edges = d.spark.createDataFrame([e[:2] for e in EDGES], "src string, dst string")
    return nodes, nodes.select("pipeline").distinct().crossJoin(F.broadcast(edges))


def _rates(d):
    rate, service = (F.col("v") % 400).cast("double"), (300 + F.col("event_id") % 200).cast("double")
    return d.request.select("event_id", rate.alias("rate"), service.alias("service"))


R_SQL = "rs AS (SELECT event_id, CAST(v % 400 AS DOUBLE) AS rate, CAST(300 + event_id % 200 AS DOUBLE) AS service FROM request)"


@query("e14_queueing_latency", f"WITH {R_SQL}, g AS (SELECT *, CASE WHEN rate = 0 THEN 1.0::DOUBLE ELSE rate END AS r FROM rs) SELECT event_id, round(CASE WHEN r / service >= 1 THEN 999999999 ELSE (r / service) * (r / service) / (1 - r / service) / r * 1000000 END, 4) AS guarded, round(CASE WHEN rate = 0 THEN 0 WHEN rate = service THEN NULL ELSE (rate / service) * (rate / service) / (1 - rate / service) / rate * 1000000 END, 4) AS zero FROM g")
def e14(d):
    r, s = F.col("rate"), F.col("service")
    return _rates(d).select("event_id", F.round(C.queueing_us(r, s), 4).alias("guarded"), F.round(C.queueing_us(r, s, "zero"), 4).alias("zero"))


@query("e15_stage_latency", "SELECT part_id, CASE WHEN part_id % 11 < 2 THEN 0 ELSE prep + infer * batch_size + post END AS avg_latency, CASE WHEN part_id % 11 < 2 THEN 0 ELSE (prep + infer + post) * batch_size END AS max_latency, CASE WHEN part_id % 11 < 2 THEN 0 ELSE prep + infer + post + cpu END AS cost FROM model_profile")
def e15(d):
    """Two of every eleven parts stand for sources and sinks."""
    return C.stage_latency(d.model_profile.withColumn("transfer", F.col("cpu")), F.col("part_id") % 11 < 2).select("part_id", "avg_latency", "max_latency", "cost")


WALK = "walk(pipeline, node, t) AS (SELECT pipeline, node, 0.0::DOUBLE FROM {0} WHERE node = 'datasource' UNION ALL SELECT e.pipeline, e.dst, w.t + n.max_proc + n.transfer + n.queue FROM walk w JOIN {1} e ON e.pipeline = w.pipeline AND e.src = w.node JOIN {0} n ON n.pipeline = e.pipeline AND n.node = e.dst)".format
PATHS = f"WITH RECURSIVE {NODE_SQL}, {WALK('nodes', 'edges')}"


@query("e16_critical_path", f"{PATHS} SELECT pipeline, node, max(t) AS start2here FROM walk GROUP BY ALL")
def e16(d):
    return C.start_to_here(*_dag(d)).select("pipeline", "node", "start2here")


@query("e16_path_cost", f"WITH RECURSIVE {NODE_SQL}, up(pipeline, node, at_node) AS (SELECT pipeline, node, node FROM nodes UNION ALL SELECT u.pipeline, u.node, e.src FROM up u JOIN edges e ON e.pipeline = u.pipeline AND e.dst = u.at_node) SELECT u.pipeline, u.node, sum(CASE WHEN n.node = 'datasource' THEN 0 ELSE n.max_proc + n.transfer END) AS start2here_cost FROM up u JOIN nodes n ON n.pipeline = u.pipeline AND n.node = u.at_node GROUP BY ALL")
def e16_cost(d):
    nodes, edges = _dag(d)
    rows = nodes.withColumn("own_cost", F.col("max_proc") + F.col("transfer"))
    return C.start_to_here_cost(rows, edges, "own_cost").select("pipeline", "node", "start2here_cost")


@query("e17_time_left", f"WITH RECURSIVE {NODE_SQL}, up(pipeline, node, at_node, w, t) AS (SELECT pipeline, node, node, 1.0::DOUBLE, CASE WHEN node = 'sink' THEN 0.0::DOUBLE ELSE 1.2 * (queue + max_proc) END FROM nodes UNION ALL SELECT u.pipeline, u.node, e.dst, u.w * 1.2, u.t + u.w * 1.2 * CASE WHEN e.dst = 'sink' THEN 0 ELSE 1.2 * (n.queue + n.max_proc) END FROM up u JOIN edges e ON e.pipeline = u.pipeline AND e.src = u.at_node JOIN nodes n ON n.pipeline = u.pipeline AND n.node = e.dst) SELECT pipeline, node, round(max(t), 6) AS time_left FROM up GROUP BY ALL")
def e17(d):
    return C.time_left(*_dag(d)).select("pipeline", "node", F.round("time_left", 6).alias("time_left"))


TIMING = f"""WITH RECURSIVE {NODE_SQL}, links AS (SELECT e.*, a.device <> b.device AND e.dst <> 'sink' AS far, a.device = b.device AS near, a.max_proc AS proc FROM edges e JOIN nodes a ON a.pipeline = e.pipeline AND a.node = e.src JOIN nodes b ON b.pipeline = e.pipeline AND b.node = e.dst),
way(pipeline, node, t) AS (SELECT pipeline, node, 0.0::DOUBLE FROM nodes WHERE node = 'datasource' UNION ALL SELECT l.pipeline, l.dst, CASE WHEN far THEN 0 ELSE w.t + proc END FROM way w JOIN links l ON l.pipeline = w.pipeline AND l.src = w.node),
reach AS (SELECT pipeline, node, max(t) AS reach FROM way GROUP BY ALL),
chain(pipeline, node, t) AS (SELECT pipeline, node, reach FROM reach WHERE node NOT IN ('datasource', 'sink') UNION ALL SELECT l.pipeline, l.dst, c.t + proc FROM chain c JOIN links l ON l.pipeline = c.pipeline AND l.src = c.node WHERE near AND l.dst <> 'sink'),
timed AS (SELECT n.pipeline, n.node, coalesce(max(t), 0) AS start_time, CASE WHEN n.node IN ('datasource', 'sink') THEN 0 ELSE max(t) + any_value(max_proc) END AS end_time FROM nodes n LEFT JOIN chain c ON c.pipeline = n.pipeline AND c.node = n.node GROUP BY n.pipeline, n.node),
seed AS (SELECT l.pipeline, l.dst AS node, max(t.end_time) AS t FROM links l JOIN timed t ON t.pipeline = l.pipeline AND t.node = l.src WHERE l.dst = 'sink' GROUP BY ALL UNION ALL SELECT l.pipeline, l.src, r.reach + l.proc FROM links l JOIN reach r ON r.pipeline = l.pipeline AND r.node = l.src WHERE far),
duty(pipeline, node, t) AS (SELECT * FROM seed UNION ALL SELECT l.pipeline, l.src, d.t FROM duty d JOIN links l ON l.pipeline = d.pipeline AND l.dst = d.node WHERE NOT far)
SELECT t.pipeline, t.node, start_time, end_time, coalesce(max(d.t), 0) AS duty_cycle FROM timed t LEFT JOIN duty d ON d.pipeline = t.pipeline AND d.node = t.node GROUP BY t.pipeline, t.node, start_time, end_time"""


@query("e18_duty_cycle", TIMING)
def e18(d):
    return C.stage_timing(*_dag(d)).select("pipeline", "node", "start_time", "end_time", "duty_cycle")


@query("e19_replicas_up", f"WITH {R_SQL} SELECT event_id, CAST(least(4, greatest(1, ceil(rate * 5 / (service * 0.8::DOUBLE)), ceil(rate * 5 / (2 * service * 0.95::DOUBLE)))) AS BIGINT) AS replicas FROM rs")
def e19(d):
    return _rates(d).select("event_id", C.replicas_up(F.lit(1).cast("long"), F.col("rate") * 5, F.col("service"), 2 * F.col("service")).alias("replicas"))


@query("e20_replicas_down", f"WITH {R_SQL} SELECT event_id, CAST(least(4, greatest(1, ceil(rate * 5 / (service * 0.7::DOUBLE)), ceil(rate * 5 / (2 * service * 0.9::DOUBLE)))) AS BIGINT) AS replicas FROM rs")
def e20(d):
    return _rates(d).select("event_id", C.replicas_down(F.lit(4).cast("long"), F.col("rate") * 5, F.col("service"), 2 * F.col("service")).alias("replicas"))


QUEUE = "greatest(30, CASE WHEN {0} < 1 THEN CAST(ceil({0} * {0} / (2 * (1 - {0}))) AS BIGINT) ELSE 30 END)".format
QUEUES = f"""WITH q AS (SELECT event_id, CAST(v % 400 AS DOUBLE) AS rate, CAST(infer_batch_size AS DOUBLE) AS b, 1000000.0::DOUBLE / (300 + v % 4000) AS pr, 1000000.0::DOUBLE / ((500 + event_id % 5000) * infer_batch_size) AS ir, 1000000.0::DOUBLE / (200 + v % 3001) AS po FROM request),
p AS (SELECT *, least(pr, rate) AS prepared FROM q), i AS (SELECT *, least(ir, prepared / b) AS inferred FROM p)
SELECT event_id, {QUEUE('(rate / pr)')} AS prep_queue, {QUEUE('(prepared / b / ir)')} AS infer_queue, {QUEUE('(inferred * b / po)')} AS post_queue, CAST({QUEUE('(inferred * b / po)')} * b AS BIGINT) AS send_queue, round(least(po, inferred * b), 6) AS throughput FROM i"""


@query("e21_queue_size", QUEUES)
def e21(d):
    v = F.col("v")
    sizes = C.queue_sizes((v % 400).cast("double"), 300 + v % 4000, 500 + F.col("event_id") % 5000, 200 + v % 3001, F.col("infer_batch_size"))
    return d.request.select("event_id", *[(F.round(c, 6) if n == "throughput" else c).alias(n) for n, c in sizes.items()])


@query("e22_merged_profile", "SELECT model, device_type, round(sum(prep * rate) / sum(rate), 6) AS prep, round(sum(infer * rate) / sum(rate), 6) AS infer, round(sum(post * rate) / sum(rate), 6) AS post, max(cpu) AS cpu, max(mem) AS mem, max(cpu % 37) AS gpu, max(mem % 411) AS gpu_mem, max(mem * 3) AS input_size, max(infer * 2) AS output_size, sum(rate) AS rate FROM model_profile GROUP BY ALL")
def e22(d):
    rows = d.model_profile.withColumns({"gpu": F.col("cpu") % 37, "gpu_mem": F.col("mem") % 411, "input_size": F.col("mem") * 3, "output_size": F.col("infer") * 2})
    out = C.merged_profile(rows, ["model", "device_type"], ("cpu", "mem", "gpu", "gpu_mem", "input_size", "output_size"))
    return out.withColumns({c: F.round(c, 6) for c in ("prep", "infer", "post")})


@query(
    "e23_edge_shift",
    f"""WITH RECURSIVE {NODE_SQL}, fit AS (SELECT pipeline, node AS moved FROM nodes WHERE input_size * 0.6 > output_size AND allowed AND node NOT IN ('datasource', 'sink')),
    copies AS (SELECT pipeline || '/' || moved AS pipeline, pipeline AS of_, moved, node, CASE WHEN node = moved THEN edge_proc ELSE max_proc END AS max_proc, CASE WHEN node = moved THEN edge_transfer ELSE transfer END AS transfer, queue FROM nodes JOIN fit USING (pipeline)),
    ways AS (SELECT pipeline || '/' || moved AS pipeline, src, dst FROM edges JOIN fit USING (pipeline)), {WALK('copies', 'ways')}
    SELECT of_ AS pipeline, moved AS node, max(t) AS latency FROM walk JOIN copies USING (pipeline, node) WHERE node = 'sink' GROUP BY ALL HAVING max(t) <= 3500""",
)
def e23(d):
    return C.shift_candidates(*_dag(d), F.lit(3500))


@query("e24_cheapest_batch", "SELECT model, arg_min(batch_size, (cost, batch_size)) AS batch_size, min(cost) AS cost FROM (SELECT model, batch_size, prep + infer * batch_size + post AS latency, (prep + infer + post) / CAST(batch_size AS DOUBLE) AS cost FROM model_profile) WHERE batch_size <= 16 AND latency < 3000 GROUP BY model")
def e24(d):
    p, i, o, b = (F.col(c) for c in ("prep", "infer", "post", "batch_size"))
    return C.cheapest_batch(d.model_profile.withColumns({"latency": p + i * b + o, "cost": (p + i + o) / b, "slo": F.lit(3000)}), ["model"], 16)


SIDES = "sides AS (SELECT mem % 2 = 0 AS is_edge, sum(CASE WHEN batch_size = CASE WHEN mem % 2 = 0 THEN 8 ELSE 16 END AND infer > 0 THEN 1000000.0::DOUBLE / infer ELSE 0 END) AS throughput, CAST(floor(sum(rate)) AS BIGINT) AS load FROM model_profile GROUP BY 1)"


@query("e25_side_throughput", f"WITH {SIDES} SELECT is_edge, round(throughput, 4) AS throughput, load FROM sides")
def e25(d):
    return C.side_throughput(d.model_profile.withColumn("is_edge", F.col("mem") % 2 == 0)).withColumn("throughput", F.round("throughput", 4))


@query("e26_split_decision", f"WITH {SIDES}, w AS (SELECT max(throughput) FILTER (is_edge) AS e, max(throughput) FILTER (NOT is_edge) AS s, max(load) FILTER (is_edge) AS el, max(load) FILTER (NOT is_edge) AS sl FROM sides), p AS (SELECT round(0.5 + CASE WHEN e / s > 2 THEN 0.006 WHEN e / s > 1.5 THEN 0.003 WHEN e / s > 1 THEN 0.001 WHEN e / s < 0.5 THEN -0.006 WHEN e / s < 0.67 THEN -0.003 ELSE -0.001 END, 6)::DOUBLE AS point, round(((el + sl) / 2.0::DOUBLE - el) / greatest(el, sl), 6) AS \"offset\" FROM w) SELECT *, CASE WHEN \"offset\" > 0.1 THEN 'to_edge' WHEN \"offset\" < -0.1 THEN 'to_server' ELSE 'stay' END AS move FROM p")
def e26(d):
    out = C.split_decision(C.side_throughput(d.model_profile.withColumn("is_edge", F.col("mem") % 2 == 0)))
    return out.select(F.round("point", 6).alias("point"), F.round("offset", 6).alias("offset"), "move")


@query("e27_rounded_throughput", "SELECT part_id, CAST(floor(floor(batch_size / (infer * 0.000001::DOUBLE)) / 10) * 10 AS BIGINT) AS throughput FROM model_profile")
def e27(d):
    return d.model_profile.select("part_id", C.rounded_throughput(F.col("batch_size"), F.col("infer")).alias("throughput"))


@query("e28_pick_batch", "WITH c AS (SELECT user_id, 'Brand#' || CAST(10 * (1 + user_id % 5) + 1 + user_id % 3 AS VARCHAR) AS model, max(v) % 5000 AS req_rate, max(slo) AS slo FROM request GROUP BY ALL), s AS (SELECT model, sum(req_rate) AS demand FROM c WHERE slo >= 300 GROUP BY model), p AS (SELECT model, part_id, batch_size, CAST(floor(floor(batch_size / (infer * 0.000001::DOUBLE)) / 10) * 10 AS BIGINT) AS thr FROM model_profile) SELECT model, coalesce(arg_min(batch_size, part_id) FILTER (thr > coalesce(demand, 0) AND batch_size > 1), 1) AS batch_size FROM p LEFT JOIN s USING (model) GROUP BY model")
def e28(d):
    """Clients with an SLO to spare are selected."""
    model = F.concat(F.lit("Brand#"), 10 * (1 + F.col("user_id") % 5) + 1 + F.col("user_id") % 3)
    clients = d.request.groupBy("user_id", model.alias("model")).agg((F.max("v") % 5000).alias("req_rate"), F.max("slo").alias("slo"))
    profiles = d.model_profile.withColumn("throughput", C.rounded_throughput(F.col("batch_size"), F.col("infer")))
    return C.pick_batch(profiles, clients.where("slo >= 300"), ["model"], ["part_id"])


@query("e29_budget_ranking", "SELECT event_id, CAST(rank() OVER (PARTITION BY stream, day ORDER BY slo - (t2 - t1) DESC) AS BIGINT) AS place FROM request")
def e29(d):
    from pyspark.sql import Window

    w = Window.partitionBy("stream", "day").orderBy(F.desc(F.col("slo") - (F.col("t2") - F.col("t1"))))
    return d.request.select("event_id", F.rank().over(w).cast("long").alias("place"))


@query("e30_pipeline_utilisation", "WITH u AS (SELECT device_type AS device, model || '/' || CAST(part_id // 50 AS VARCHAR) AS subgraph, round(sum(rate / round(1000000.0::DOUBLE / (infer * batch_size * 10))), 9) AS utilisation FROM model_profile GROUP BY ALL), f AS (SELECT * FROM u WHERE utilisation <= 1.0) SELECT device, subgraph, round(utilisation, 6) AS utilisation FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY utilisation DESC, subgraph) AS rn FROM f) WHERE rn = 1")
def e30(d):
    subgraph = F.concat_ws("/", "model", F.floor(F.col("part_id") / 50))
    df = d.model_profile.select(F.col("device_type").alias("device"), subgraph.alias("subgraph"), F.col("rate").alias("fps"), (F.col("infer") * F.col("batch_size") * 10).alias("latency"))
    return C.pipeline_utilisation(df).withColumn("utilisation", F.round("utilisation", 6))


@query("e31_paths", f"WITH RECURSIVE {NODE_SQL}, en AS (SELECT * FROM edges WHERE dst <> 'sink'), w(pipeline, last, path, n) AS (SELECT DISTINCT pipeline, node, node, 1 FROM nodes WHERE node <> 'sink' UNION ALL SELECT w.pipeline, e.dst, w.path || '>' || e.dst, n + 1 FROM w JOIN en e ON e.pipeline = w.pipeline AND e.src = w.last WHERE n < 3) SELECT pipeline, path FROM w UNION ALL SELECT a.pipeline, a.dst || '+' || b.dst FROM en a JOIN en b ON a.pipeline = b.pipeline AND a.src = b.src AND a.dst < b.dst")
def e31(d):
    _, edges = _dag(d)
    pairs = C.sibling_pairs(edges).select("pipeline", F.concat_ws("+", "a", "b").alias("path"))
    return C.downward_paths(edges).unionByName(pairs)


NEEDS = "dv AS (SELECT device_type AS device, max(mem) * 2 AS free FROM model_profile GROUP BY 1), nd AS (SELECT model, max(mem) AS need FROM model_profile GROUP BY 1)"


def _places(d):
    devices = d.model_profile.groupBy(F.col("device_type").alias("device")).agg((F.max("mem") * 2).alias("free"))
    return devices, d.model_profile.groupBy("model").agg(F.max("mem").alias("need"))


@query("e32_largest_gap", f"WITH {NEEDS} SELECT model, device, free, need, gap FROM (SELECT *, free - need AS gap, row_number() OVER (PARTITION BY model ORDER BY free - need DESC, device) AS rn FROM nd, dv WHERE free - need >= 500) WHERE rn = 1")
def e32(d):
    return C.largest_gap(*_places(d)).select("model", "device", "free", "need", "gap")


@query("e33_memory_headroom", "SELECT device_type, CAST(sum(mem) AS BIGINT) AS used, CAST(1000 * count(*) - sum(mem) AS BIGINT) AS headroom FROM model_profile GROUP BY 1")
def e33(d):
    return d.model_profile.groupBy("device_type").agg(F.sum("mem").alias("used"), (F.count(F.lit(1)) * 1000 - F.sum("mem")).alias("headroom"))


@query("e34_largest_batch", "WITH c AS (SELECT user_id AS client, 'Brand#' || CAST(10 * (1 + user_id % 5) + 1 + user_id % 3 AS VARCHAR) AS model, max(v) AS budget, max(t2 - t1) AS transmission FROM request GROUP BY ALL), m AS (SELECT DISTINCT model, batch_size, infer AS latency FROM model_profile) SELECT client, coalesce(max(batch_size), 2) AS batch_size FROM c LEFT JOIN m ON c.model = m.model AND 2 * latency < budget - transmission AND batch_size <= 8 GROUP BY client")
def e34(d):
    model = F.concat(F.lit("Brand#"), 10 * (1 + F.col("user_id") % 5) + 1 + F.col("user_id") % 3)
    clients = d.request.groupBy(F.col("user_id").alias("client"), model.alias("model")).agg(F.max("v").alias("budget"), F.max(F.col("t2") - F.col("t1")).alias("transmission"))
    models = d.model_profile.select("model", "batch_size", F.col("infer").alias("latency")).distinct()
    return C.largest_batch(clients, models, 8)
