from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make(spark):
    """Documents from (doc_id, text[, source]); extra columns carry names that operators use inside."""

    def build(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            from pyspark.sql import functions as F

            for name in ("uid", "doc", "size", "key_", "fp", "rank", "hash", "part_", "same"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
