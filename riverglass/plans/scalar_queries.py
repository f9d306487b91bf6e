"""Projections and filters (family B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import query


@query("b1_frame_id", "SELECT event_id, CAST(split_part(split_part(path, ']', 1), '|', 3) AS BIGINT) AS frame_id FROM paths")
def b1(d):
    return d.paths.select("event_id", S.frame_id(F.col("path")).alias("frame_id"))


@query("b2_origin_stream", "SELECT event_id, split_part(split_part(path, ']', 1), '|', 2) AS origin FROM paths")
def b2(d):
    return d.paths.select("event_id", S.origin_stream(F.col("path")).alias("origin"))


@query("b3_sender_host", "SELECT event_id, CASE WHEN len(string_split(path, '[')) = 2 THEN '' ELSE split_part(split_part(path, '[', 2), '|', 1) END AS host FROM paths")
def b3(d):
    return d.paths.select("event_id", S.sender_host(F.col("path")).alias("host"))


@query("b4_arrival_pkg_size", r"SELECT event_id, CAST(regexp_extract(path, '\|([0-9]+)\][^\[]*$', 1) AS BIGINT) AS size_b FROM paths")
def b4(d):
    return d.paths.select("event_id", S.arrival_package_size(F.col("path")).alias("size_b"))


@query("b5_path_builder", "SELECT event_id, path || '[serv|sink|3|' || CAST(event_id % 7 AS VARCHAR) || ']' AS longer FROM paths")
def b5(d):
    return d.paths.select("event_id", S.append_hop(F.col("path"), F.lit("serv"), F.lit("sink"), F.lit("3"), (F.col("event_id") % 7).cast("string")).alias("longer"))


@query("b6_split_any", r"SELECT event_id, len(regexp_split_to_array(path, '[\[\]|]')) AS parts, regexp_split_to_array(path, '[\[\]|]')[3] AS third FROM paths")
def b6(d):
    parts = S.split_any(F.col("path"), "[]|")
    return d.paths.select("event_id", F.size(parts).cast("long").alias("parts"), F.get(parts, F.lit(2)).alias("third"))


@query(
    "b7_abbreviate",
    """SELECT DISTINCT event_type || '_' || stream || '_server2_yolov5n_traffic_fullness' AS phrase,
       substr(event_type, 1, 4) || '_stre_serv2_y5n_trfc_full' AS short FROM request""",
)
def b7(d):
    phrase = F.concat_ws("_", "event_type", "stream", F.lit("server2"), F.lit("yolov5n"), F.lit("traffic"), F.lit("fullness"))
    return d.request.select(phrase.alias("phrase")).distinct().select("phrase", S.abbreviate(F.col("phrase")).alias("short"))


@query("b8_object_class", "SELECT event_id, CASE WHEN model_name LIKE '%click%' THEN 'people' ELSE 'cars' END AS class FROM arrival")
def b8(d):
    head = F.when(F.col("model_name").contains("click"), "retina1").otherwise(F.col("model_name"))
    return d.arrival.select("event_id", S.object_class(head).alias("class"))


@query("b9_remove_replace", "SELECT event_id, replace(stream, 'stream', '') AS removed, replace(stream, 'stream', 's-') AS replaced FROM request")
def b9(d):
    return d.request.select("event_id", S.remove_substring(F.col("stream"), "stream").alias("removed"), F.replace("stream", F.lit("stream"), F.lit("s-")).alias("replaced"))


@query("b10_fraction", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(v AS DOUBLE) / (event_id % 4) END AS ratio FROM request")
def b10(d):
    text = F.concat_ws("/", "v", F.col("event_id") % 4)
    return d.request.select("event_id", S.fraction(text).alias("ratio"))


@query("b11_time_conversions", "SELECT event_id, t0, CAST(t0 // 1000 AS BIGINT) AS ms, substr(strftime(make_timestamp(t0), '%d_%H-%M-%S'), 1, 10) AS stamp FROM request")
def b11(d):
    at = F.timestamp_micros(F.col("t0"))
    return d.request.select("event_id", F.unix_micros(at).alias("t0"), F.unix_millis(at).alias("ms"), F.substring(F.date_format(at, "dd_HH-mm-ss"), 1, 10).alias("stamp"))


@query("b12_align", "SELECT event_id, CAST(floor(t0 / 1000000) AS BIGINT) * 1000000 AS bin FROM request")
def b12(d):
    return d.request.select("event_id", S.align(F.col("t0")).alias("bin"))


@query("b13_minutes_since_start", "SELECT event_id, (t0 - (SELECT min(t0) FROM request)) / 60000000.0::DOUBLE AS minutes FROM request")
def b13(d):
    first = d.request.agg(F.min("t0").alias("first_"))
    return d.request.crossJoin(F.broadcast(first)).select("event_id", S.minutes_since(F.col("t0"), F.col("first_")).alias("minutes"))  # one row


@query("b14_host_type", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'serv' ELSE substr(sender_host, 1, 4) END AS host FROM request")
def b14(d):
    host = F.when(F.col("event_id") % 5 == 0, "virtual").otherwise(F.col("sender_host"))
    return d.request.select("event_id", S.host_type(host).alias("host"))


@query("b15_table_task", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'yolov5' ELSE 'retina' END AS task FROM request")
def b15(d):
    task = F.when(F.col("event_id") % 3 == 0, "yolov5n").otherwise("retina1")
    return d.request.select("event_id", S.table_task(task).alias("task"))


@query("b16_default_package", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 307200 WHEN 1 THEN 786432 ELSE 1228800 END::BIGINT AS size_b FROM request")
def b16(d):
    name = F.element_at(F.array(F.lit("yolo320"), F.lit("yolo512"), F.lit("yolo")), (F.col("event_id") % 3 + 1).cast("int"))
    return d.request.select("event_id", S.default_package_size(name).alias("size_b"))


@query("b17_enum_decode", "SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 9 END::BIGINT AS code FROM request")
def b17(d):
    codes = d.spark.createDataFrame([("view", 0), ("click", 1), ("signup", 2)], "event_type string, code long")
    joined = d.request.join(F.broadcast(codes), "event_type", "left")  # a dimension of three rows
    return joined.select("event_id", F.coalesce("code", F.lit(9).cast("long")).alias("code"))


@query("b18_recent_window", "SELECT event_id, t0 FROM request WHERE t0 >= (SELECT max(t0) FROM request) - 120000000000")
def b18(d):
    return recent(d.request, "t0", 120_000_000_000).select("event_id", "t0")


def recent(df, at: str, width: int, as_of: int | None = None):
    """Rows of the last ``width`` before ``as_of`` (default: the largest time); one scalar is read, then the filter is a literal and is pushed to the scan."""
    last = as_of if as_of is not None else df.agg(F.max(at)).first()[0]
    return df.where(F.col(at) >= F.lit((last or 0) - width))


@query("b19_stream_filter", "SELECT stream, count(*) AS n FROM request WHERE stream LIKE '%1%' OR stream = 'stream2' GROUP BY stream")
def b19(d):
    return d.request.where(F.col("stream").contains("1") | (F.col("stream") == "stream2")).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@query("b20_active_gpu", "SELECT system, count(*) AS n FROM hw WHERE gpu_0_mem_usage <> 0 OR gpu_1_mem_usage <> 0 GROUP BY system")
def b20(d):
    return d.hw.where(F.greatest("gpu_0_mem_usage", "gpu_1_mem_usage") != 0).groupBy("system").agg(F.count(F.lit(1)).alias("n"))


@query("b21_total_gpu_mem", "SELECT system, CAST(sum(gpu_0_mem_usage + gpu_1_mem_usage) AS BIGINT) AS total FROM hw GROUP BY system")
def b21(d):
    return d.hw.groupBy("system").agg(F.sum(F.col("gpu_0_mem_usage") + F.col("gpu_1_mem_usage")).alias("total"))


@query("b22_latency_bound", "SELECT system, count(*) AS n FROM sink_log WHERE latency_us < 200000 GROUP BY system")
def b22(d):
    return d.sink_log.where(F.col("latency_us") < 200_000).groupBy("system").agg(F.count(F.lit(1)).alias("n"))


@query("b23_clip", "SELECT event_id, greatest(7, v) AS at_least, least(1.0::DOUBLE, greatest(0.0::DOUBLE, v / 20000.0::DOUBLE)) AS share FROM request")
def b23(d):
    return d.request.select("event_id", F.greatest(F.lit(7).cast("long"), "v").alias("at_least"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") / 20000.0)).alias("share"))


@query("b24_min_max", "SELECT event_id, (v - (SELECT min(v) FROM request)) / CAST((SELECT max(v) - min(v) FROM request) AS DOUBLE) AS scaled FROM request")
def b24(d):
    ends = d.request.agg(F.min("v").alias("low_"), F.max("v").alias("high_"))
    return d.request.crossJoin(F.broadcast(ends)).select("event_id", ((F.col("v") - F.col("low_")) / (F.col("high_") - F.col("low_"))).alias("scaled"))  # one row


@query("b25_frame_sampling", "SELECT event_id FROM request WHERE event_id % (30 / 12.0::DOUBLE) < 1")
def b25(d):
    return d.request.where(F.pmod(F.col("event_id").cast("double"), F.lit(30 / 12)) < 1).select("event_id")


@query("b27_run_names", "SELECT event_id, CAST(v AS DOUBLE) / 10 AS a, CAST(event_id % 9 AS DOUBLE) AS b FROM request WHERE event_id % 11 <> 0")
def b27(d):
    name = F.when(F.col("event_id") % 11 == 0, "broken-name").otherwise(F.concat_ws("-", F.concat_ws(",", F.floor(F.col("v") / 10), F.col("v") % 10), F.col("event_id") % 9))
    parts = F.transform(F.split(name, "-"), lambda p: F.replace(p, F.lit(","), F.lit(".")).try_cast("double"))
    return d.request.select("event_id", parts[0].alias("a"), parts[1].alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


@query("b28_box_forms", "SELECT det_id, sort_key, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy, x2 - x1 AS w, y2 - y1 AS h, x1 + (x2 - x1) AS right_x FROM detections")
def b28(d):
    cx, cy, w, h = S.centre_form(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return d.detections.select("det_id", "sort_key", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), S.corner_form(F.col("x1"), F.col("y1"), w, h)[2].alias("right_x"))


@query("b29_argmax_softmax", "SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS BIGINT) AS best, round(1 / list_sum(list_transform(x, lambda e: exp(CAST(e AS DOUBLE) - list_max(x)))), 6) AS top FROM logits")
def b29(d):
    return d.logits.select("vec_id", S.argmax(F.col("x")).alias("best"), F.round(F.array_max(S.softmax(F.col("x"))), 6).alias("top"))


@query("b30_log_sum_exp", "SELECT vec_id, round(list_max(x) + ln(list_sum(list_transform(x, lambda e: exp(CAST(e AS DOUBLE) - list_max(x))))), 6) AS lse FROM logits")
def b30(d):
    return d.logits.select("vec_id", F.round(S.log_sum_exp(F.col("x")), 6).alias("lse"))


@query(
    "b31_entropy",
    """WITH e AS (SELECT vec_id, list_transform(x, lambda e: exp(CAST(e AS DOUBLE))) AS e FROM logits), p AS (SELECT vec_id, list_transform(e, lambda y: y / list_sum(e)) AS p FROM e)
       SELECT vec_id, round(-list_sum(list_transform(p, lambda y: y * ln(y + 1e-10))), 6) AS entropy FROM p""",
)
def b31(d):
    return d.logits.select("vec_id", S.softmax(F.col("x")).alias("p")).select("vec_id", F.round(S.entropy(F.col("p")), 6).alias("entropy"))
