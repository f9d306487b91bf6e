"""Archives and vector searches against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverglass.llm import ann, mips, warc
from riverglass.llm.common import new_path
from riverglass.llm.hilbert import hilbert_key

STRAY = "before WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1"


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    rows = [(i, f"http://h/{i}", f"<html>page {i % 40} {'x' * (i % 90)}</html>") for i in range(200)]
    rows += [(500, "u", STRAY), (501, None, None), (502, "x", ""), (505, "é", "é\r\n\r\nWARC/1.0\r\n"), (504, "é", "é\r\n\r\nWARC/1.0\r\n"), (None, "n", "zzz"), (506, "b", "WARC/1." * 20_000), (507, "r", "row"), (507, "r", "row")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("offset", F.lit(2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = [tuple(r) for r in warc.round_trip(pages, least).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = {}
    for p, _, html in rows:
        b = (html or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(p, first.get(b, p))
    want = []
    for p, _, html in rows:
        b = (html or "").encode()
        later = b in first and first[b] != p
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if later else "response", first[b] if later else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_warc_payloads_and_empty_table(spark):
    rows = [(1, "u", STRAY), (2, "v", "plain")]
    path = new_path(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_records(spark, path).collect()}
    assert got == {1: ("u", STRAY), 2: ("v", "plain")}
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0


def test_round_trip_writes_gzipped_archives(spark):
    rows = [(i, "u", f"<html>{i} {'<p>some text</p>' * 300}</html>") for i in range(50)] + [(90, "u", STRAY)]
    path = new_path(spark, "test-warc")
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), path=path).count()
    files = sorted(Path(path.removeprefix("file://")).glob("part-*"))
    records = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert got == 51 and records.count(b"WARC-Record-ID: <urn:page:") == 52 and STRAY.encode() in records
    assert 5 * sum(f.stat().st_size for f in files) < sum(len(html) for *_, html in rows)


def test_hilbert_neighbours_are_adjacent():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def vectors(spark, rng, n=600, dim=16):
    centres = rng.normal(size=(8, dim))
    x = (centres[rng.integers(0, 8, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)
    x[50:90] = x[50]  # copies
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(10_000, None), (10_100, []), (10_200, [0.0] * dim), (10_300, [float("nan")] * dim), (10_400, [float("inf")] * dim), (10_500, [None] * dim), (None, [1.0] * dim), (100, [9.0] * dim)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)), x


def test_nearest_neighbours(spark):
    df, x = vectors(spark, np.random.default_rng(1))
    got = ann.search(df, every=20).collect()
    ids, v = np.arange(len(x)), x.astype(np.float64)
    hits = []
    for q in range(0, len(x), 20):
        found = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        other = ids != q
        want = ids[other][np.lexsort((ids[other], d[other]))[:10]]
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        assert all(r.score == d[r.vec_id] for r in found)
        hits.append(len({r.vec_id for r in found} & set(want.tolist())) / 10)
    assert np.mean(hits) >= 0.9
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 60), key=lambda r: r["rank"])] == list(range(50, 60))
    assert {r.query_id for r in got} == set(range(0, len(x), 20))


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.search(df).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert [(r.query_id, r.vec_id) for r in mips.search(df).orderBy("rank").collect()] == [(0, 2), (0, 1)]
    assert ann.search(df.limit(0)).count() == 0 and mips.search(df.limit(0)).count() == 0


def test_inner_products_are_exact(spark):
    df, x = vectors(spark, np.random.default_rng(2))
    got = mips.search(df, block=64, query_block=8).collect()
    x = np.concatenate([np.floor(64 * x.astype(np.float64)).astype(np.int64), np.zeros((1, x.shape[1]), np.int64)])
    ids = np.concatenate([np.arange(len(x) - 1), [10_200]])
    for q in [*range(0, 600, 20), 10_200]:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        other = ids != q
        order = np.lexsort((ids[other], -s[other]))[:20]
        found = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.vec_id, r.score) for r in found] == list(zip(ids[other][order].tolist(), s[other][order].tolist(), strict=True))


def test_magic_in_urls_does_not_split_records(spark):
    rows = [(i, f"http://example.org/WAR\nC/1.{i}/WARC/1.1", f"page {i}") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.round_trip(pages).collect()) == [(i, 6) for i in range(6)]


def test_second_read_with_other_splits(spark, monkeypatch):
    """The files may be split in another way when pieces are read again; a record that is cut short is flagged."""
    rows = [(i, f"u{i}", STRAY if i % 3 == 0 else f"page {i}") for i in range(60)]
    path = new_path(spark, "test-warc-splits")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    holders = warc._holders

    def changed(records, stray):
        found = holders(records, stray)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return found

    monkeypatch.setattr(warc, "_holders", changed)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        got = {r.page_id: r.payload for r in warc.read_records(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {k: v and bytes(v).decode() for k, v in got.items()} == {i: (t if i == 0 or i % 3 else None) for i, _, t in rows}
    cut = spark.read.text(path, wholetext=True).selectExpr("substring(value, 1, length(value) - 9) AS value").where("value <> ''")
    short = new_path(spark, "test-warc-short")
    cut.write.text(short)
    kinds = [r.record_type for r in warc.read_records(spark, short).collect()]
    assert kinds.count("truncated") >= 1 and len(kinds) == 60


@pytest.mark.parametrize("size", [1e3, 1e7, 1e8])
def test_large_components_score_exactly(spark, size):
    """Lengths beyond 2**31 whole units among ordinary ones; near ties that doubles cannot tell apart."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[20:40] = x[21]
    x[40:60] = x[42] + rng.integers(0, 3, (20, 4)) / 64 / size
    large = [i for i in range(300) if (i % 7 == 0 or 40 <= i < 60) and (i % 20 or size < 1e8)]  # products of two of 1e8 would leave a long
    x[large] *= size
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = mips.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=32, query_block=8).collect()
    whole = [[int(c) for c in np.floor(64 * v)] for v in x]
    for q in range(0, 300, 20):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q)[:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in scores]


def test_scores_beyond_a_long(spark):
    schema = "vec_id long, embedding array<double>"
    with pytest.raises(Exception, match="(?i)overflow|too large|long"):
        mips.search(spark.createDataFrame([(0, [1e9, 0.0]), (1, [1e9, 0.0])], schema)).collect()
    got = mips.search(spark.createDataFrame([(0, [1e9, 0.0]), (1, [-1e9, 0.0]), (2, [1.0, 0.0])], schema)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 64 * 64 * 10**9), (1, -(2**63))]
