"""Readers of logs, traces, profiles and detection files; parsing is done with Spark functions on lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import object_class, origin_stream


def find_tables(spark: SparkSession, keyword: str, schema: str | None = None) -> list[str]:
    """Names of the catalog's tables (of ``schema``, or the current one) that hold ``keyword``, in which ``*`` stands for any text."""
    return sorted(t.name for t in spark.catalog.listTables(schema, pattern=f"*{keyword}*"))


def load_fact(fact: DataFrame, **like: str) -> DataFrame:
    """Rows of one wide fact table whose dimension columns hold the given texts; on partition columns this prunes folders."""
    for column, text in like.items():
        fact = fact.where(F.col(column).contains(text))
    return fact


def load_facts(spark: SparkSession, keyword: str, schema: str | None = None, **like: str) -> DataFrame | None:
    """All catalog tables whose name holds ``keyword``, read as one: each filtered by itself, so that its partitions are pruned, then united by
    column names (what a table lacks is null). None where no table matches.
    """
    found = [load_fact(spark.table(f"{schema}.{t}" if schema else t), **like) for t in find_tables(spark, keyword, schema)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def scan_table(spark: SparkSession, name: str, schema: str, columns: list[str]) -> DataFrame:
    """Columns of a catalog table; an empty table of ``schema`` where there is none."""
    df = spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)
    return df.select(*columns)


def scan(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Columns of a Parquet fact table; an empty table of ``schema`` where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    df = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    return df.select(*columns)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path).withColumn("file", F.col("_metadata.file_path"))


def sink_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``[path]|ts,ts,..|diff,diff,..``: file, stream, class, generated_us, arrival_us (last time), latency_us (sum of the differences)."""
    parts = F.regexp_extract
    line = F.col("value")
    head, times, gaps = (parts(line, r"^(.*\])\|([0-9,]+)\|([0-9,]+)$", i) for i in (1, 2, 3))
    numbers = lambda c: F.transform(F.split(c, ","), lambda x: x.try_cast("long"))
    rows = _lines(spark, path).where(line.rlike(r"\]\|[0-9,]+\|[0-9,]+$")).select("file", head.alias("head"), numbers(times).alias("ts"), numbers(gaps).alias("gaps"))
    total = F.aggregate("gaps", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("file", origin_stream(F.col("head")).alias("stream"), object_class(F.col("head")).alias("class"), F.col("ts")[0].alias("generated_us"), F.element_at("ts", -1).alias("arrival_us"), total.alias("latency_us"))


def batch_log(spark: SparkSession, path: str) -> DataFrame:
    """Detector lines of batch logs, ``name,start,end,size``."""
    p = F.split("value", ",")
    return _lines(spark, path).where(F.col("value").contains("yolo")).select("file", F.get(p, F.lit(0)).alias("name"), *[F.get(p, F.lit(i)).try_cast("long").alias(n) for i, n in ((1, "start"), (2, "end"), (3, "size"))])


def profile_log(spark: SparkSession, path: str) -> DataFrame:
    """Stage times of profile lines ``key,flag,d1,..,d6`` with flag 1; warm-up lines are skipped."""
    p = F.split("value", ",")
    rows = _lines(spark, path).where(~F.col("value").contains("WARMUP") & (F.get(p, F.lit(1)) == "1"))
    return rows.select("file", F.get(p, F.lit(0)).alias("key"), *[F.get(p, F.lit(i + 2)).try_cast("long").alias(f"d{i}") for i in range(6)])


def object_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="Frame_Index long, person long, car long, others long")


def total_objects(spark: SparkSession, path: str) -> DataFrame:
    """``{stream: {people, cars}}`` as rows."""
    text = spark.read.text(path, wholetext=True)
    streams = F.from_json("value", "map<string,struct<people:bigint,cars:bigint>>")
    return text.select(F.explode(streams).alias("stream", "v")).select("stream", "v.people", "v.cars")


def _json_texts(spark: SparkSession, path: str, field: str = "") -> DataFrame:
    """(file, value): every JSON object at the top level of the files; a file holds one, over any number of lines, or one on each line."""
    lines = _lines(spark, path)
    alone = F.col("value").rlike(r"^\s*\{.*\}\s*$")
    split_up = lines.where(~alone & (F.trim("value") != "")).select("file").distinct()
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path")).join(split_up, "file", "left_semi")
    return lines.where(alone).join(split_up, "file", "left_anti").select("file", "value").unionByName(whole.select("file", "value"))


def bandwidth(spark: SparkSession, path: str) -> DataFrame:
    """``{bandwidth_limits: [{time, mbps}]}``, a JSON text on one line or more: file, time, mbps."""
    text = _json_texts(spark, path, "bandwidth_limits")
    steps = F.from_json("value", "struct<bandwidth_limits:array<struct<time:bigint,mbps:double>>>")["bandwidth_limits"]
    return text.select("file", F.inline(steps))


def frame_objects(spark: SparkSession, path: str) -> DataFrame:
    """``{stream: {object: [count per frame]}}``, a JSON text on one line or more: stream, object, frame, objects."""
    streams = _json_texts(spark, path).select(F.explode(F.from_json("value", "map<string,map<string,array<bigint>>>")).alias("stream", "m"))
    return streams.select("stream", F.explode("m").alias("object", "xs")).select("stream", "object", F.posexplode("xs").alias("frame", "objects"))


def rl_log(spark: SparkSession, path: str, kind: str = "episodeEnd") -> DataFrame:
    """Lines of one kind of a ragged log: file, its first two numbers (us: a time or the first latency; round_us: the second), average reward (field 5) and loss (field 6)."""
    p = F.split("value", ",")
    rows = _lines(spark, path).where(F.get(p, F.lit(0)) == kind)
    return rows.select("file", F.get(p, F.lit(1)).try_cast("long").alias("us"), F.get(p, F.lit(2)).try_cast("long").alias("round_us"), F.get(p, F.lit(5)).try_cast("double").alias("reward"), F.get(p, F.lit(6)).try_cast("double").alias("loss"))


def rollouts(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Mean objectives per agent (from the file's name) and rollout; the first ``first`` rollouts."""
    df = spark.read.csv(path, header=True, schema="rollout_id long, obj1 double, obj2 double, obj3 double").withColumn("agent", F.regexp_extract(F.col("_metadata.file_path"), r"agent_(\w+?)[./]", 1))
    out = df.groupBy("agent", "rollout_id").agg(*[F.avg(o).alias(o) for o in ("obj1", "obj2", "obj3")])
    if first is None:
        return out
    w = Window.partitionBy("agent").orderBy("rollout_id")
    return out.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= first).drop("rn_")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """An image's name, a count, and ``x y w h score`` lines, once or more in a file: image, idx, x, y, w, h, score."""
    record = r"\r?\n(?=\S+\r?\n(?:0(?:\r?\n|$)|[1-9]\d*\r?\n\S+ \S))"
    lines = F.split("record", r"\r?\n")
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"\s+$", ""), record)).alias("record"))
    rows = text.select(F.get(lines, F.lit(0)).alias("image"), F.posexplode(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))).alias("idx", "line"))
    p = F.split("line", " ")
    return rows.select("image", "idx", *[F.get(p, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("x", "y", "w", "h", "score"))])


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A ``# name`` or ``-- name`` header, then box lines: every box gets the last header above it in its file.

    Lines are placed by their number in a split, and a window over each split's lines carries the header; a split's first lines take the last header before it.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    name = F.regexp_extract("value", r"^(?:#|--)\s*(\S+)", 1)
    rows = raw.withColumn("name", F.when(name != "", name))
    inside = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("file", "split").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("row"))).alias("end_"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carry_", F.last("end_", ignorenulls=True).over(before)).drop("end_")
    boxes = rows.withColumn("image", F.last("name", ignorenulls=True).over(inside)).join(ends, ["file", "split"])
    p = F.split(F.trim("value"), r"\s+")
    return boxes.where(F.col("name").isNull() & (F.size(p) >= 4)).select(F.coalesce("image", "carry_").alias("image"), "row", *[F.get(p, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("x", "y", "w", "h"))])


def profile_rows(flat: Column, fields: tuple[str, ...] = ("batch_size", "prep", "infer", "post")) -> Column:
    """A flat array of repeated groups of fields as an array of structs; an incomplete last group goes."""
    k = len(fields)
    groups = F.floor(F.size(flat) / k).cast("int")
    index = F.when(groups > 0, F.sequence(F.lit(0), groups - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.struct(*[F.get(flat, i * k + j).alias(n) for j, n in enumerate(fields)]))


def natural_key(name: Column) -> list[Column]:
    """Sort columns for natural order: the text before the digits, the digits as a number, the name."""
    return [F.regexp_extract(name, r"^([^0-9]*)", 1), F.regexp_extract(name, r"^[^0-9]*([0-9]+)", 1).try_cast("long"), name]
