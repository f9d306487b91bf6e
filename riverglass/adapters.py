"""Domain tables over the base tables: column lists in SQL that Spark and DuckDB read alike.

``Domain(spark, folder).request`` is a DataFrame; ``with_tables(sql)`` puts the same definitions before a SQL text as
common table expressions. Only the columns a query uses are read: the definitions are plain projections.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PERIODS = (1, 3, 7, 15, 30, 60)
_US = "unix_micros(CAST(ts AS TIMESTAMP))"
_SHIP_US = "unix_micros(CAST(l_shipdate AS TIMESTAMP))"
_V = "CAST(floor(value * 100) AS BIGINT)"
_D = "CAST({} AS DOUBLE)".format

#: name: (source, columns, filter). Later tables may build on earlier ones.
TABLES: dict[str, tuple[str, dict[str, str], str | None]] = {
    "request0": ("events", {"event_id": "event_id", "user_id": "user_id", "event_type": "event_type", "stream": "concat('stream', user_id % 4)", "sender_host": "concat('edge', user_id % 3)", "infer_batch_size": "1 + event_id % 4", "t0": _US, "v": _V, "t1": f"{_US} + 10 + event_id % 97"}, None),
    "request1": ("request0", {"event_id": "event_id", "user_id": "user_id", "event_type": "event_type", "stream": "stream", "sender_host": "sender_host", "infer_batch_size": "infer_batch_size", "v": "v", "t0": "t0", "t1": "t1", "t2": "t1 + 5 + v % 53", "t3": "CASE WHEN event_id % 50 = 0 THEN t1 + 4 + v % 53 ELSE t1 + 5 + v % 53 + v END"}, None),
    "request": ("request1", {"event_id": "event_id", "user_id": "user_id", "event_type": "event_type", "stream": "stream", "sender_host": "sender_host", "infer_batch_size": "infer_batch_size", "v": "v", "day": "CAST(floor(t0 / 86400000000) AS BIGINT)", "slo": "100 + v % 400", "t0": "t0", "t1": "t1", "t2": "t2", "t3": "t3", "t4": "t3 + 1 + event_id % 31", "t5": "t3 + 2 + event_id % 31 + v % 211", "t6": "t3 + 3 + event_id % 31 + v % 211 + event_id % 13", "t7": "t3 + 4 + event_id % 31 + v % 211 + event_id % 13 + v % 17", "t8": "t3 + 104 + event_id % 31 + v % 211 + event_id % 13 + v % 17 + v % 977", "t9": "t3 + 105 + event_id % 31 + v % 211 + event_id % 13 + v % 17 + v % 977 + event_id % 7", "t10": "t3 + 106 + event_id % 31 + v % 211 + event_id % 13 + v % 17 + v % 977 + event_id % 7 + v % 89", "t11": "t3 + 107 + event_id % 31 + v % 211 + event_id % 13 + v % 17 + v % 977 + event_id % 7 + v % 89 + v % 7"}, None),
    "arrival": ("request", {"timestamps": "t0", "event_id": "event_id", "stream": "stream", "model_name": "event_type", "sender_host": "sender_host", "receiver_host": "concat('edge', event_id % 3)", **{f"arrival_rate_{p}s": f"{_D(f'v % {97 + p}')} / 10" for p in PERIODS}, **{f"coeff_var_{p}s": f"{_D(f'v % {31 + p}')} / 100" for p in PERIODS}, "p95_out_queueing_duration_us": "t1 - t0", "p95_transfer_duration_us": "t2 - t1", "p95_queueing_duration_us": "v", "p95_total_package_size_b": "1000 + v % 5000", "late_requests": "v % 5", "queue_drops": "event_id % 3"}, None),
    "process": ("request", {"timestamps": "t0", "event_id": "event_id", "stream": "stream", "model_name": "event_type", "device": "sender_host", "infer_batch_size": "infer_batch_size", **{f"thrput_{p}s": f"{_D(f'v % {53 + p}')}" for p in PERIODS}, "p95_prep_duration_us": "t4 - t3", "p95_batch_duration_us": "1 + v % 211", "p95_infer_duration_us": "100 + v % 977", "p95_post_duration_us": "1 + v % 89", "p95_input_size_b": "1000 + v % 900", "p95_output_size_b": "300 + v % 700", "p95_encoded_size_b": "100 + v % 80"}, None),
    "hw": ("lineitem", {"timestamps": f"{_SHIP_US} + l_orderkey", "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "system": "l_returnflag", "batch_size": "l_linenumber", "cpu_usage": "CAST(floor(l_quantity) AS BIGINT)", "mem_usage": "CAST(floor(l_extendedprice / 10) AS BIGINT)", "rss_mem_usage": "CAST(floor(l_extendedprice / 20) AS BIGINT)", "gpu_usage": "CAST(floor(l_discount * 1000) AS BIGINT)", "gpu_mem_usage": "l_partkey % 7 * 100", "gpu_0_mem_usage": "l_partkey % 7 * 100", "gpu_1_mem_usage": "l_suppkey % 3 * 50", "power": "CAST(floor(l_tax * 1000) AS BIGINT)"}, None),
    "sink_log": ("events", {"event_id": "event_id", "latency_us": "CAST(floor(value * 1000) AS BIGINT)", "arrival_us": _US, "pipeline": "CASE WHEN user_id % 2 = 0 THEN 'traffic' ELSE 'people' END", "class": "CASE WHEN event_type IN ('view', 'click') THEN 'cars' ELSE 'people' END", "system": "concat('sys', event_id % 3)"}, None),
    "paths": ("events", {"event_id": "event_id", "path": "CASE WHEN event_id % 2 = 0 THEN concat('[edge', user_id % 3, '|cam', user_id % 4, '|', event_id, '|1|1|', " + _V + ", '|', 2 * " + _V + ", '][server|yolo|', event_id % 9, '|2|', " + _V + " + 7, ']') ELSE concat('[edge', user_id % 3, '|cam', user_id % 4, '|', event_id, '|1|1|', " + _V + ", '|', 2 * " + _V + ", ']') END"}, None),
    "detections": ("lineitem", {"det_id": "l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey", "sort_key": "l_suppkey * 1000000 + CAST(floor(l_extendedprice) AS BIGINT)", "image_id": "l_orderkey", "x1": "l_partkey % 300", "y1": "l_suppkey % 200", "x2": "l_partkey % 300 + 5 + CAST(floor(l_quantity) AS BIGINT)", "y2": "l_suppkey % 200 + 5 + CAST(floor(l_extendedprice) AS BIGINT) % 60", "score": f"{_D('CAST(floor(l_extendedprice) AS BIGINT) % 1000')} / 1000", "class_id": "CAST(l_linenumber % 3 AS BIGINT)"}, None),
    "ground_truth": ("lineitem", {"image_id": "l_orderkey", "gt_id": "l_partkey", "x1": "l_partkey % 300 + 2", "y1": "l_suppkey % 200 + 2", "x2": "l_partkey % 300 + 7 + CAST(floor(l_quantity) AS BIGINT)", "y2": "l_suppkey % 200 + 7 + CAST(floor(l_extendedprice) AS BIGINT) % 60", "setting": "CASE l_orderkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END", "ignored": "l_suppkey % 5 = 0"}, "l_linenumber = 1"),
    "bandwidth": ("orders", {"trace": "o_custkey % 5", "tm": "o_orderkey", "mbps": "o_totalprice / 1000"}, None),
    "model_profile": ("part", {"part_id": "p_partkey", "model": "p_brand", "device_type": "p_type", "batch_size": "CAST(power(2, p_size % 5) AS BIGINT)", "prep": "10 + CAST(floor(p_retailprice) AS BIGINT) % 90", "infer": "100 + CAST(floor(p_retailprice) AS BIGINT) % 900", "post": "5 + CAST(floor(p_retailprice) AS BIGINT) % 45", "cpu": "p_partkey % 100", "mem": "500 + p_partkey % 900", "rate": f"{_D('1 + p_partkey % 37')}"}, None),
    "trajectory": ("events", {"agent": "user_id % 5", "episode": f"CAST(floor({_US} / 86400000000) AS BIGINT)", "step": "event_id", "tm": _US, "reward": "value / 500", "value": f"{_D('event_id % 100')} / 100", "terminal": "event_type = 'signup'"}, None),
    "rollouts": ("embeddings", {"agent": "CAST(label AS BIGINT)", "rollout_id": "vec_id", "obj1": "CAST(embedding[{i0}] AS DOUBLE)", "obj2": "CAST(embedding[{i1}] AS DOUBLE)", "obj3": "CAST(embedding[{i2}] AS DOUBLE)"}, None),
    "fl_updates": ("embeddings", {"cluster": "CAST(label AS BIGINT)", "client": "vec_id", "layer": "vec_id % 4", "weights": "embedding", "latest_loss": f"{_D('vec_id % 17')} / 10"}, None),
    "logits": ("embeddings", {"vec_id": "vec_id", "x": "embedding"}, None),
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


class Domain:
    """The domain tables of a folder of base tables, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in TABLES:
            raise AttributeError(name)
        source, columns, where = TABLES[name]
        df = getattr(self, source)
        df = df.where(where) if where else df
        return df.selectExpr(*[f"{_spark(e)} AS `{n}`" for n, e in columns.items()])


def _spark(expr: str) -> str:
    return expr.replace("{i0}", "0").replace("{i1}", "1").replace("{i2}", "2")


def _duck(expr: str) -> str:
    expr = expr.replace("{i0}", "1").replace("{i1}", "2").replace("{i2}", "3")
    return re.sub(r"unix_micros\(CAST\((\w+) AS TIMESTAMP\)\)", r"epoch_us(\1)", expr)


def with_tables(sql: str) -> str:
    """``sql`` for DuckDB, preceded by the domain tables that it names."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(TABLES[name][0])
                needed.append(name)

    need(re.sub(r"'[^']*'", "", sql))
    ctes = []
    for name in needed:
        source, columns, where = TABLES[name]
        body = ", ".join(f'{_duck(e)} AS "{n}"' for n, e in columns.items())
        ctes.append(f"{name} AS (SELECT {body} FROM {source}" + (f" WHERE {where}" if where else "") + ")")
    if not ctes:
        return sql
    sql = sql.strip()
    m = re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", sql)
    head = "WITH RECURSIVE " if m and m[1] else "WITH "
    return head + ",\n".join(ctes) + (",\n" + sql[m.end() :] if m else "\n" + sql)
