"""Writers: fact tables with partition columns, idempotent appends, detection exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_fact(df: DataFrame, path: str, partitions: list[str]) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def save_fact(df: DataFrame, name: str, path: str, partitions: list[str]) -> None:
    """A catalog table over the files at ``path``, appended to if it is there."""
    df.write.mode("append").partitionBy(*partitions).format("parquet").option("path", path).saveAsTable(name)


def append_new(df: DataFrame, path: str, keys: list[str], partitions: list[str]) -> None:
    """Append the rows whose keys the table does not hold yet, one per key. Partition columns in ``keys`` limit what is read."""
    rows = df.dropDuplicates(keys)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    append_fact(rows, path, partitions)


def detection_text(detections: DataFrame) -> DataFrame:
    """(image, value): the image's name, its number of boxes, and a line ``x y w h score`` per box, best first."""
    line = F.concat_ws(" ", "x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.format_number("score", 3))
    boxes = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("det_id").alias("i"), line.alias("line"))))
    per = detections.groupBy(F.col("image_id").cast("string").alias("image")).agg(boxes.alias("boxes"))
    return per.select("image", F.concat_ws("\n", "image", F.size("boxes").cast("string"), F.array_join(F.transform("boxes", lambda b: b["line"]), "\n")).alias("value"))


def export_detections(detections: DataFrame, path: str) -> None:
    detection_text(detections).select("value").write.text(path)
