"""Helpers shared by the corpus operators: stored intermediates, prefix sums, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and Spark runs in one process, a new one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-riverglass-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/riverglass/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, short lineage, known size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again: what was made of them is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this package from the shared folder; call it once results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/riverglass")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until ``df`` has no column so called (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_sample(df: DataFrame, key: str, rows: int, salt: str) -> DataFrame:
    """At most ``rows`` rows of ``df``, picked by a hash of ``key``: all if there are no more, else nine tenths of ``rows`` on average.

    A filter, not a sort: no task gathers candidates of the others.
    """
    n = df.count()
    if n <= rows:
        return df
    steps = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(steps)) < int(0.9 * rows / n * steps)).limit(rows)


def join_counted(rows: DataFrame, named: DataFrame, keys: list[str], copies: str, share: int = 4096) -> DataFrame:
    """Inner join of ``rows`` with ``named``, which has one row per key and in ``copies`` the number of ``rows`` that have it (and is stored, as it is read three times).

    Keys with more than one in ``share`` of all rows, which are fewer than ``share`` whatever the table's size, are broadcast, so no task gathers
    a hot key; all others are joined by a shuffle.
    """
    total = named.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) * share > total
    few = F.broadcast(named.where(hot).drop(copies))
    rest = rows.join(F.broadcast(named.where(hot).select(*keys)), keys, "left_anti").join(named.where(~hot).drop(copies), keys)
    return rows.join(few, keys).unionByName(rest)


def arrow_map(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]], rows: int = 256, after: Callable[[], None] | None = None) -> DataFrame:
    """Run ``fn`` over small slices of ``df`` in Arrow batches: columns as lists in, columns as lists out; ``after`` ends a task."""
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = fn(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)
        if after:
            after()

    return df.mapInArrow(run, out)


def running_totals(df: DataFrame, group: list[str], order: list[str], value: str, out: str, name: str = "prefix") -> DataFrame:
    """Add ``out``, the sum of ``value`` over the rows of the same ``group`` before this one in ``order``.

    The rows are range-partitioned on (group, order), so a large group is spread over many tasks; each task sums
    its own sorted rows, and one total per (task, group) gives every task its offsets. ``group`` columns must not
    be null; ties in ``order`` get some fixed order.
    """
    cols = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("part_", T.IntegerType()), T.StructField("local_", T.LongType())])

    def run(batches):
        last, carried = object(), 0
        part = TaskContext.get().partitionId()
        for pdf in batches:
            v = pdf[value].to_numpy(dtype=np.int64)
            keys = list(zip(*(pdf[g] for g in group), strict=True)) if group else [()] * len(v)
            sums = np.empty(len(v), np.int64)
            starts = [i for i in range(len(v)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(v)], strict=True):
                if keys[a] != last:
                    last, carried = keys[a], 0
                c = np.cumsum(v[a:b]) + carried
                sums[a:b] = c - v[a:b]
                carried = int(c[-1])
            yield pdf.assign(part_=np.int32(part), local_=sums)

    keys = [*group, *order]
    local = store(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema), name)
    w = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy(*group, "part_").agg(F.sum(value).alias("all_")).withColumn("offset_", F.coalesce(F.sum("all_").over(w), F.lit(0))).drop("all_")
    return local.join(offsets, [*group, "part_"]).select(*cols, (F.col("local_") + F.col("offset_")).alias(out))


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (u long, v long), each vertex with the smallest vertex of its component: (node, root).

    Alternating large-star and small-star steps, which take about log2 of the longest path; each step's edges are
    written to the shared folder. Empty edges give an empty table.
    """
    now = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("root").alias("root"))
        before = mark
        # least ids are written before they are joined, so that the join is a stage of its own, and a hub's edges can be split
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = store(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = store(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = store(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        now = store(large.join(least, "u").select(F.inline(ends)).where("u <> v").distinct(), "edges")
