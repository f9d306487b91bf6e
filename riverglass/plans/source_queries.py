"""Sources and sinks (family A): what is written in a format must read back as the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch, stored
from ..sources import readers as R
from ..sources import sinks as S
from .registry import query


def _text(df, value, name):
    path = scratch(df.sparkSession, name)
    df.select(value.alias("value")).write.text(path)
    return path


@query("a1_load_fact", "SELECT stream, count(*) AS n, CAST(sum(late_requests) AS BIGINT) AS late, count(queue_drops) AS told FROM (SELECT stream, model_name, late_requests, CASE WHEN event_id % 2 = 0 THEN queue_drops END AS queue_drops FROM arrival) WHERE stream LIKE '%1%' AND model_name LIKE '%i%' GROUP BY stream")
def a1(d):
    """Two experiments' arrival tables, of which one has a column more, and a table of another kind that must not match."""
    mark, columns = f"run{uuid.uuid4().hex}", ["event_id", "model_name", "late_requests", "stream"]
    even = F.col("event_id") % 2 == 0
    S.save_fact(d.arrival.where(even).select(*columns, "queue_drops"), f"{mark}_a_arr", scratch(d.spark, "fact"), ["stream"])
    S.save_fact(d.arrival.where(~even).select(*columns), f"{mark}_b_arr", scratch(d.spark, "fact"), ["stream"])
    S.save_fact(d.process.select("event_id", "stream"), f"{mark}_a_proc", scratch(d.spark, "fact"), ["stream"])
    try:
        rows = R.load_facts(d.spark, f"{mark}_*_arr", stream="1", model_name="i")
        return stored(rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum("late_requests").alias("late"), F.count("queue_drops").alias("told")), "facts")
    finally:
        for name in ("a_arr", "b_arr", "a_proc"):
            d.spark.sql(f"DROP TABLE IF EXISTS {mark}_{name}")


@query("a2_scan_fact", "SELECT event_id, late_requests FROM arrival")
def a2(d):
    path = scratch(d.spark, "fact")
    S.append_fact(d.arrival.select("event_id", "stream", "late_requests", "queue_drops"), path, ["stream"])
    return R.scan(d.spark, path, "event_id long, late_requests long, queue_drops long, stream string", ["event_id", "late_requests"])


@query("a3_sink_log", "SELECT CASE WHEN event_id % 2 = 0 THEN 'people' ELSE 'cars' END AS class, stream, t0 AS generated_us, t11 AS arrival_us, (t1 - t0) + (t11 - t1) AS latency_us FROM request")
def a3(d):
    head = F.concat(F.lit("["), F.when(F.col("event_id") % 2 == 0, "retina").otherwise("plate"), F.lit("|"), F.col("stream"), F.lit("|1]"))
    line = F.concat_ws("|", head, F.concat_ws(",", "t0", "t1", "t11"), F.concat_ws(",", F.col("t1") - F.col("t0"), F.col("t11") - F.col("t1")))
    return R.sink_log(d.spark, _text(d.request, line, "sink")).drop("file")


@query("a4_batch_log", "SELECT 'yolo' || infer_batch_size AS name, t6 AS start, t8 AS \"end\", infer_batch_size AS size FROM request WHERE event_id % 3 <> 0")
def a4(d):
    line = F.concat_ws(",", F.concat(F.when(F.col("event_id") % 3 == 0, "retina").otherwise("yolo"), F.col("infer_batch_size").cast("string")), "t6", "t8", "infer_batch_size")
    return R.batch_log(d.spark, _text(d.request, line, "batch")).drop("file")


@query("a5_profile_log", "SELECT stream AS key, t5 - t4 AS d0, t6 - t5 AS d1, t7 - t6 AS d2, t8 - t7 AS d3, t9 - t8 AS d4, t10 - t9 AS d5 FROM request WHERE event_id % 4 <> 0 AND event_id % 5 <> 0")
def a5(d):
    key = F.when(F.col("event_id") % 4 == 0, F.concat("stream", F.lit("WARMUP"))).otherwise(F.col("stream"))
    gaps = [F.col(f"t{i + 1}") - F.col(f"t{i}") for i in range(4, 10)]
    line = F.concat_ws(",", key, F.when(F.col("event_id") % 5 == 0, "0").otherwise("1"), *gaps)
    return R.profile_log(d.spark, _text(d.request, line, "profile")).drop("file")


COUNTS = "SELECT image_id, count(*) FILTER (class_id = 0) AS person, count(*) FILTER (class_id = 2) AS car, count(*) FILTER (class_id = 1) AS others FROM detections GROUP BY 1"


def _counts(d):
    c = F.col("class_id")
    return d.detections.groupBy("image_id").agg(F.count_if(c == 0).alias("person"), F.count_if(c == 2).alias("car"), F.count_if(c == 1).alias("others"))


@query("a6_object_counts", f"SELECT image_id AS \"Frame_Index\", person, car, others FROM ({COUNTS})")
def a6(d):
    path = scratch(d.spark, "counts")
    _counts(d).withColumnRenamed("image_id", "Frame_Index").write.csv(path, header=True)
    return R.object_counts(d.spark, path)


@query("a7_total_objects", "SELECT system AS stream, count(*) FILTER (class = 'people') AS people, count(*) FILTER (class = 'cars') AS cars FROM sink_log GROUP BY 1")
def a7(d):
    per = d.sink_log.groupBy("system").agg(F.count_if(F.col("class") == "people").alias("people"), F.count_if(F.col("class") == "cars").alias("cars"))
    one = per.agg(F.map_from_entries(F.collect_list(F.struct("system", F.struct("people", "cars")))).alias("m"))  # an entry per system
    return R.total_objects(d.spark, _text(one, F.to_json("m"), "totals"))


@query("a8_bandwidth_trace", "SELECT tm AS time, mbps FROM bandwidth")
def a8(d):
    block = F.floor(F.col("tm") / 500).alias("b")  # a trace file holds the steps of a stretch of time
    traces = d.bandwidth.groupBy("trace", block).agg(F.collect_list(F.struct(F.col("tm").alias("time"), "mbps")).alias("bandwidth_limits"))
    path = scratch(d.spark, "bandwidth")
    traces.select(F.to_json(F.struct("bandwidth_limits")).alias("value"), (F.col("trace") * 1000 + F.col("b") % 1000).alias("f")).repartition("f").write.partitionBy("f").text(path)
    return R.bandwidth(d.spark, path).drop("file")


@query("a9_frame_objects", "SELECT stream, 'v' AS object, CAST(row_number() OVER (PARTITION BY stream, user_id, day ORDER BY event_id) - 1 AS BIGINT) AS frame, v AS objects FROM request")
def a9(d):
    xs = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "v"))), lambda s: s["v"])
    per = d.request.groupBy("stream", "user_id", "day").agg(xs.alias("xs"))  # the events of a user's day
    text = per.select(F.to_json(F.create_map("stream", F.create_map(F.lit("v"), "xs"))).alias("value"))
    path = scratch(d.spark, "frames")
    text.write.text(path)
    return R.frame_objects(d.spark, path).withColumn("frame", F.col("frame").cast("long"))


@query("a10_rl_log", "SELECT t0 AS us, v / 100.0::DOUBLE AS reward, event_id / 1000.0::DOUBLE AS loss FROM request WHERE event_id % 2 = 0")
def a10(d):
    kind = F.when(F.col("event_id") % 2 == 0, "episodeEnd").otherwise("step")
    line = F.concat_ws(",", kind, "t0", F.lit("0"), F.lit("0"), F.lit("0"), F.col("v") / 100, F.col("event_id") / 1000)
    return R.rl_log(d.spark, _text(d.request, line, "rl")).select("us", "reward", "loss")


@query("a11_rollouts", "SELECT CAST(agent AS VARCHAR) AS agent, rollout_id, obj1, obj2, obj3 FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY rollout_id) AS rn FROM rollouts) WHERE rn <= 20")
def a11(d):
    path = scratch(d.spark, "rollouts")
    named = d.rollouts.withColumn("file", F.concat(F.lit("agent_"), F.col("agent")))
    named.select("file", "rollout_id", "obj1", "obj2", "obj3").write.partitionBy("file").csv(path, header=True)
    return R.rollouts(d.spark, f"{path}/file=*", first=20).select("agent", "rollout_id", "obj1", "obj2", "obj3")


BOXES = "SELECT CAST(image_id AS VARCHAR) AS image, CAST(x1 AS DOUBLE) AS x, CAST(y1 AS DOUBLE) AS y, CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h, score FROM detections"


@query("a12_predictions", BOXES)
def a12(d):
    path = scratch(d.spark, "predictions")
    S.detection_text(d.detections).select("value").write.text(path)
    return R.predictions(d.spark, path).drop("idx")


@query("a13_ground_truth", "SELECT CAST(image_id AS VARCHAR) AS image, CAST(x1 AS DOUBLE) AS x, CAST(y1 AS DOUBLE) AS y, CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h FROM ground_truth")
def a13(d):
    g = d.ground_truth
    box = F.concat_ws(" ", "x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    line = F.concat(F.lit("-- "), F.col("image_id").cast("string"), F.lit("\n"), F.array_join(F.collect_list(box), "\n"))
    path = scratch(d.spark, "truth")
    g.groupBy("image_id").agg(line.alias("value")).select("value").write.text(path)
    return R.ground_truth(d.spark, path).drop("row")


@query("a14_profile_rows", "SELECT part_id, batch_size, prep, infer, post FROM model_profile")
def a14(d):
    flat = F.array("batch_size", "prep", "infer", "post", F.lit(99).cast("long"))  # the last group is incomplete
    return d.model_profile.select("part_id", F.inline(R.profile_rows(flat)))


@query("a15_natural_order", "SELECT DISTINCT 'run' || (event_id % 12) AS name, CAST(event_id % 12 AS BIGINT) AS place FROM request")
def a15(d):
    from pyspark.sql import Window

    names = d.request.select(F.concat(F.lit("run"), F.col("event_id") % 12).alias("name")).distinct()
    return names.select("name", (F.row_number().over(Window.orderBy(*R.natural_key(F.col("name")))) - 1).cast("long").alias("place"))  # one row per run folder


@query("a16_append_fact", "SELECT stream, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM (SELECT stream, v FROM request UNION ALL SELECT stream, v FROM request WHERE event_id % 2 = 0) GROUP BY stream")
def a16(d):
    path, rows = scratch(d.spark, "append"), d.request.select("event_id", "stream", "v")
    S.append_fact(rows, path, ["stream"])
    S.append_fact(rows.where("event_id % 2 = 0"), path, ["stream"])
    return d.spark.read.parquet(path).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query("a17_idempotent_append", "SELECT event_id, stream, v FROM request")
def a17(d):
    path, rows = scratch(d.spark, "idempotent"), d.request.select("event_id", "stream", "v")
    S.append_new(rows.where("event_id % 3 <> 0"), path, ["event_id", "stream"], ["stream"])
    S.append_new(rows.union(rows), path, ["event_id", "stream"], ["stream"])
    return d.spark.read.schema(rows.schema).parquet(path).select("event_id", "stream", "v")


@query("a18_cached_result", "SELECT stream, count(*) AS n FROM request GROUP BY stream")
def a18(d):
    path = scratch(d.spark, "cached")
    d.request.groupBy("stream").agg(F.count(F.lit(1)).alias("n")).write.csv(path, header=True)
    return d.spark.read.csv(path, header=True, schema="stream string, n long")


@query("a19_latency_history", "SELECT event_id, v FROM request ORDER BY t0, event_id")
def a19(d):
    return d.request.orderBy("t0", "event_id").select("event_id", "v")


@query("a20_detection_export", "SELECT CAST(image_id AS VARCHAR) AS image, count(*) AS n FROM detections GROUP BY 1")
def a20(d):
    text = S.detection_text(d.detections)
    return text.select(F.get(F.split("value", "\n"), F.lit(0)).alias("image"), F.get(F.split("value", "\n"), F.lit(1)).cast("long").alias("n"))
