"""Operator 10: remove byte strings of ``length`` bytes that start anywhere else, by a range-partitioned suffix sort.

A suffix per byte would be a hundred times the corpus, so suffixes that cannot repeat are ruled out first, without
loss. Every ``length``-byte window names an anchor, the ``CORE``-byte string in it with the least hash (the
rightmost of equals). The choice depends on the window's bytes only, so equal windows have equal anchors at equal
places. Neighbouring windows with one anchor form a run, and

* a run whose whole context (all bytes of its windows) occurs more than once repeats as a whole;
* a run whose anchor occurs in no other context has no window that starts elsewhere;
* of all other runs, one for each distinct context goes on, cut into parts of windows whose distances to the anchor
  share a multiple of ``PART``. The same two tests hold for a part: it repeats if all its bytes do, and none of it
  does if the bytes common to all windows of the part are unique. The windows of the parts that are left, one part for each
  distinct content, are the suffixes to sort.

These suffixes are range-partitioned by their leading bytes with Spark's sampled splitters, each bucket is sorted by
multikey quicksort on 64-bit words (the first eight bytes, then a 128-bit digest that stands for the compared ``length``
bytes), and equal neighbours repeat, inside a bucket or across the boundary of two. The place of a suffix is the last part of the
partitioning key, so a string with millions of copies is dealt over many buckets. Anchors, contexts and parts with very many copies
are joined by broadcast (``join_counted``), all others by a shuffle.

Defined cases: an empty table gives an empty one; null and empty texts have no bytes; texts shorter than ``length`` keep all; rows that repeat as a whole
are texts of their own and so repeat each other; very long texts are cut into segments that overlap, and other columns are ignored,
whatever their names; a null doc_id stays null; bytes that stay are joined even where that splits a character.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, join_counted, store

CORE = 40
PART = 16
_SEGMENT = 1 << 20
_BUCKET = 1 << 19  # suffixes that a task sorts in memory
_LOW = np.uint64(0xFFFFFFFF)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _core_hashes(data: bytes) -> np.ndarray:
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = len(data) - CORE + 1
    with np.errstate(over="ignore"):
        h = words[:n] * _ODD[0]
        for j in range(1, CORE // 8):
            h += words[8 * j : 8 * j + n] * _ODD[j]
            h ^= h >> np.uint64(29)
        h *= _ODD[5]
    return h ^ (h >> np.uint64(32))


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks read forwards and backwards."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: bytes, length: int = 400) -> list[tuple[int, int, int, int, int]]:
    """(first window, windows, distance to the anchor, anchor hash, context hash) of each run of windows that name one anchor."""
    out = []
    for start in range(0, max(len(data) - length + 1, 0), _SEGMENT):
        part = data[start : start + _SEGMENT + length - 1]
        h = _core_hashes(part)
        key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        least = _window_least(key, length - CORE + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        sizes = np.diff(np.concatenate((first, [len(least)])))
        anchors = (_LOW - (least[first] & _LOW)).astype(np.int64)
        cores = h[anchors].view(np.int64)
        for lo, n, anchor, core in zip(first.tolist(), sizes.tolist(), anchors.tolist(), cores.tolist(), strict=True):
            context = xxhash.xxh3_64_intdigest(part[lo : lo + n + length - 1], anchor - lo) - 2**63
            out.append((start + lo, n, anchor - lo, core, context))
    return out


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several 64-bit words: three-way partitioning on a word, and only rows equal in it go on to the next."""
    out: list[np.ndarray] = []
    stack: list[tuple[np.ndarray, int]] = [(np.arange(len(keys[0])), 0)]
    while stack:
        rows, depth = stack.pop()
        if depth == len(keys) or len(rows) < 2:
            out.append(rows)
            continue
        word = keys[depth][rows]
        if len(rows) <= 4096:
            order = np.argsort(word, kind="stable")
            word, rows = word[order], rows[order]
            cuts = np.flatnonzero(word[1:] != word[:-1]) + 1
            if len(cuts) == len(rows) - 1:
                out.append(rows)
                continue
            stack += [(part, depth + 1) for part in reversed(np.split(rows, cuts))]
            continue
        pivot = np.median(word[:: max(1, len(word) // 255)][:255].astype(np.float64))
        pivot = word[np.abs(word.astype(np.float64) - pivot).argmin()]
        stack += [(rows[word > pivot], depth), (rows[word == pivot], depth + 1), (rows[word < pivot], depth)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _text_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("doc_id", "text").alias("uid"), "text")


def _match(left: str, right: str) -> F.Column:
    return F.col(f"{left}.doc").eqNullSafe(F.col(f"{right}.doc")) & (F.col(f"{left}.uid") == F.col(f"{right}.uid"))


def repeated_starts(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc, uid, first, last): starts of all windows that also start elsewhere, as ranges."""
    texts = _text_id(docs)

    def emit(batch):
        out = {"doc": batch["doc"], "uid": batch["uid"], "runs": []}
        for text in batch["text"]:
            out["runs"].append([{"lo": a, "n": n, "back": k, "core": c, "context": x} for a, n, k, c, x in runs(text.encode("utf-8", "replace"), length)])
        return out

    long_ = texts.where(F.octet_length("text") >= length)
    found = arrow_map(long_, "doc long, uid long, runs array<struct<lo:int,n:int,back:int,core:long,context:long>>", emit, rows=64)
    found = store(found.select("doc", "uid", F.inline("runs")), "runs")
    cores = found.groupBy("core").agg(F.count(F.lit(1)).alias("n_"), F.min("context").alias("a_"), F.max("context").alias("b_")).where("n_ > 1")
    cores = store(cores.select("core", "n_", (F.col("a_") != F.col("b_")).alias("mixed")), "cores")
    found = store(join_counted(found, cores, ["core"], "n_"), "candidates")  # an anchor that occurs once has no window that repeats
    place = F.struct("doc", "uid", "lo", "n", "back")
    contexts = store(found.groupBy("core", "context", "mixed").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("at")), "contexts")
    open_ = contexts.where("mixed").select("at.*", "core")
    whole = contexts.where("copies > 1").select("core", "context", "copies")
    sure = join_counted(found, whole, ["core", "context"], "copies").select("doc", "uid", F.col("lo").alias("first"), (F.col("lo") + F.col("n") - 1).alias("last"))
    parts, some = _repeated_parts(_with_bytes(texts, open_, length), length)
    return sure.unionByName(parts).unionByName(_repeated_suffixes(some, length))


def _with_bytes(texts: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """The open runs with the bytes of their contexts: doc, uid, lo, n, back, core, data."""

    def emit(batch):
        out = {n: [] for n in ("doc", "uid", "lo", "n", "back", "core", "data")}
        for doc, uid, text, spans in zip(batch["doc"], batch["uid"], batch["text"], batch["spans"], strict=True):
            data = text.encode("utf-8", "replace")
            for s in spans:
                row = {"doc": doc, "uid": uid, **s, "data": data[s["lo"] : s["lo"] + s["n"] + length - 1]}
                for name, value in row.items():
                    out[name].append(value)
        return out

    spans = store(open_.groupBy("doc", "uid").agg(F.collect_list(F.struct("lo", "n", "back", "core")).alias("spans")), "spans")
    rows = texts.alias("t").join(spans.alias("s").hint("merge"), _match("t", "s")).select("t.doc", "t.uid", "t.text", "s.spans")
    return store(arrow_map(rows, "doc long, uid long, lo int, n int, back int, core long, data binary", emit, rows=16), "open")


def parts_of(lo: int, n: int, back: int, data: bytes, length: int) -> list[tuple[int, int, int, int, int]]:
    """(distance block, first window, last window, hash of all bytes, hash of the common bytes) of a run's parts.

    ``back`` is the distance of the run's first window to the anchor; later windows are nearer.
    """
    out = []
    for block in range((back - n + 1) // PART, back // PART + 1):
        far, near = min(back, PART * block + PART - 1), max(back - n + 1, PART * block)
        first, last = back - far, back - near
        common = back - PART * block
        every = xxhash.xxh3_64_intdigest(data[first : last + length], far) - 2**63
        shared = xxhash.xxh3_64_intdigest(data[common : common - PART + 1 + length]) - 2**63
        out.append((block, lo + first, lo + last, every, shared))
    return out


def _repeated_parts(runs_: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of the parts that repeat as a whole, and the parts to look into (doc, uid, first, last, data)."""

    def emit(batch):
        out = {"doc": batch["doc"], "uid": batch["uid"], "lo": batch["lo"], "core": batch["core"], "parts": []}
        for lo, n, back, data in zip(batch["lo"], batch["n"], batch["back"], batch["data"], strict=True):
            out["parts"].append([{"block": b, "first": f, "last": l, "every": e, "shared": c} for b, f, l, e, c in parts_of(lo, n, back, data, length)])
        return out

    schema = "doc long, uid long, lo int, core long, parts array<struct<block:int,first:int,last:int,every:long,shared:long>>"
    found = store(arrow_map(runs_, schema, emit, rows=1024).select("doc", "uid", "lo", "core", F.inline("parts")), "parts")
    place = F.struct("doc", "uid", "lo", "first", "last")
    kinds = store(found.groupBy("core", "block", "shared", "every").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("at")), "kinds")
    again = kinds.where("copies > 1").select("core", "block", "shared", "every", "copies")
    sure = join_counted(found, again, ["core", "block", "shared", "every"], "copies").select("doc", "uid", "first", "last")
    mixed = kinds.groupBy("core", "block", "shared").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")
    some = kinds.join(mixed, ["core", "block", "shared"]).select("at.*")
    some = some.groupBy("doc", "uid", "lo").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    both = runs_.select("doc", "uid", "lo", "data").alias("r").join(some.alias("s"), _match("r", "s") & (F.col("r.lo") == F.col("s.lo")))
    return sure, both.select("r.doc", "r.uid", "r.lo", "r.data", "s.spans")


def _repeated_suffixes(some: DataFrame, length: int) -> DataFrame:
    """Sorts the windows of ``some`` (doc, uid, lo, data, spans) as suffixes; those equal to a neighbour, as ranges."""

    def emit(batch):
        out = {n: [] for n in ("lead", "d0", "d1", "doc", "uid", "pos")}
        digest = xxhash.xxh3_128_digest
        for doc, uid, lo, data, spans in zip(batch["doc"], batch["uid"], batch["lo"], batch["data"], batch["spans"], strict=True):
            at = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans])
            made = np.frombuffer(b"".join([digest(data[i : i + length]) for i in (at - lo).tolist()]), "<i8").reshape(-1, 2)
            lead = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))[at - lo].astype(np.uint64)
            out["lead"].append((lead ^ np.uint64(1 << 63)).view(np.int64))
            out["d0"].append(made[:, 0])
            out["d1"].append(made[:, 1])
            out["doc"] += [doc] * len(at)
            out["uid"].append(np.full(len(at), uid, np.int64))
            out["pos"].append(at.astype(np.int32))
        return {n: v if n == "doc" else np.concatenate(v) if v else [] for n, v in out.items()}

    suffixes = arrow_map(some, "lead long, d0 long, d1 long, doc long, uid long, pos int", emit, rows=1024)
    suffixes = store(suffixes, "suffixes")
    n = max(suffixes.count() // _BUCKET + 1, int(some.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = suffixes.repartitionByRange(n, "lead", "d0", "d1", "doc", "pos")

    def bucket(batches):
        parts = list(batches)  # a bucket is one partition of the range partitioning, of about _BUCKET suffixes
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        keys = [rows[n].to_numpy(np.int64) for n in ("lead", "d0", "d1")]
        order = multikey_quicksort(keys)
        keys = [k[order] for k in keys]
        same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys]) if len(order) > 1 else np.zeros(0, bool)
        repeats = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        edge = np.zeros(len(order), np.int32)
        edge[0], edge[-1] = 1, 2
        take = np.flatnonzero(repeats | (edge > 0))
        out = rows.iloc[order[take]].copy()
        yield out.assign(part=np.int32(TaskContext.get().partitionId()), edge=edge[take], repeats=repeats[take])

    schema = "lead long, d0 long, d1 long, doc long, uid long, pos int, part int, edge int, repeats boolean"
    found = store(dealt.mapInPandas(bucket, schema), "sorted")
    place = Window.orderBy("part", "edge")  # one first and one last suffix per bucket
    key = F.struct("lead", "d0", "d1")
    edges = found.where("edge > 0").select("doc", "uid", "pos", "repeats", key.alias("k"), F.lag(key).over(place).alias("before"), F.lead(key).over(place).alias("after"))
    across = edges.where(~F.col("repeats") & (F.coalesce(F.col("k") == F.col("before"), F.lit(False)) | F.coalesce(F.col("k") == F.col("after"), F.lit(False))))
    hits = found.where("repeats").select("doc", "uid", "pos").unionByName(across.select("doc", "uid", "pos"))
    return hits.select("doc", "uid", F.col("pos").alias("first"), F.col("pos").alias("last"))


def _spans(ranges, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs, as (start, end)."""
    starts = np.array([r["first"] for r in ranges], np.int64)
    ends = np.array([r["last"] for r in ranges], np.int64) + length
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return list(zip(starts[new].tolist(), reach[np.concatenate((new[1:] - 1, [len(reach) - 1]))].tolist(), strict=True))


def cut(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, data, n_bytes, spans): every text's bytes that stay, and the removed runs."""
    ranges = repeated_starts(docs, length).groupBy("doc", "uid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    rows = _text_id(docs).alias("t").join(store(ranges, "ranges").alias("r").hint("merge"), _match("t", "r"), "left").select("t.doc", "t.text", "r.ranges")

    def run(batch):
        out = {"doc_id": batch["doc"], "data": [], "n_bytes": [], "spans": []}
        for text, found in zip(batch["text"], batch["ranges"], strict=True):
            data = (text or "").encode("utf-8", "replace")
            spans = _spans(found, len(data), length) if found else []
            at, kept = 0, []
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            out["data"].append(b"".join([*kept, data[at:]]))
            out["n_bytes"].append(len(data))
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
        return out

    return arrow_map(rows, "doc_id long, data binary, n_bytes long, spans array<struct<start:long,end:long>>", run)


def summary(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = cut(docs, length)
    kept = F.octet_length("data").cast("long")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"))
