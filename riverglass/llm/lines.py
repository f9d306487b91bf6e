"""Operator 9: remove repeated passages of whole lines.

A passage is two or more neighbouring lines that are not all blank, or one line of 50 or more words, whose bytes also
occur earlier in the table (smallest doc_id, then position). A rolling hash over ``window`` neighbouring line hashes sets a chunk boundary where it is 0 modulo ``mean``,
and so does the end of a run of blank lines; a chunk of two or more lines whose hash occurs earlier is found whole, wherever it stands. A chunk's bounds
depend on the lines around it, so passages of two or three lines, and what hangs over at both ends of longer ones, often hold no whole chunk. For
these every two neighbouring lines and every long line are hashed as well, but for those inside chunks that were found; their finds extend the chunks and stand for what chunks can't see.
Finds that continue each other in the same earlier document
are joined to one run, and a run is removed once its bytes were compared with that document's. The table's first
occurrence of a line is never removed.

Only hashes and positions are shuffled to find repeats. Texts are shuffled twice, by document, to meet the places of
repeats and then the spans to cut; both are asked for as sort-merge joins, so the plan is the same at every size.

Defined cases: null texts stay null, empty texts stay empty; a null ``doc_id`` comes after all others; rows that agree
in doc_id and text count as one occurrence and get the same result; a text of which all lines go becomes empty;
other columns pass through, whatever their names (``dedup_lines`` replaces columns called n_lines_ and n_removed_); very long texts
are taken whole, in one task each; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, store

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LONG = 50  # words that make one line a passage


def chunk_starts(lines: list[str], window: int = 2, mean: int = 2) -> list[int]:
    """First lines of the chunks; content alone decides."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) for x in lines), np.uint64, len(lines))
    with np.errstate(over="ignore"):
        roll = h.copy()
        power = _MIX
        for back in range(1, window):
            roll[back:] += h[:-back] * power
            power *= _MIX
        roll = (roll * _MIX) >> np.uint64(33)
    blank = np.fromiter((not x.strip() for x in lines), bool, len(lines))
    ends = roll % np.uint64(mean) == 0
    ends[: window - 1] = False
    ends[:-1] |= blank[:-1] & ~blank[1:]
    ends[-1:] = False
    return [0, *(np.flatnonzero(ends) + 1).tolist()]


def chunks(lines: list[str], **shape) -> list[tuple[int, int]]:
    """(start, n_lines) of the chunks without blank lines at their ends, where two or more lines are left."""
    out, starts = [], chunk_starts(lines, **shape)
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        while a < b and not lines[a].strip():
            a += 1
        while b > a and not lines[b - 1].strip():
            b -= 1
        if b - a > 1:
            out.append((a, b - a))
    return out


def _identified(docs: DataFrame) -> DataFrame:
    """(doc, uid, text): rows that agree in doc_id and text are one occurrence."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("doc_id", "text").alias("uid"), "text")


def _same(left: str, right: str) -> F.Column:
    return F.col(f"{left}.doc").eqNullSafe(F.col(f"{right}.doc")) & (F.col(f"{left}.uid") == F.col(f"{right}.uid"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc, uid, start, n_lines) of the lines to remove, spans of a document apart from each other: their bytes also occur earlier in the table."""
    keys = store(_keys(docs), "keys")
    whole = store(_later(keys.where("inside = -1")), "chunks")
    found = whole.select(F.col("doc").alias("c_doc"), F.col("uid").alias("c_uid"), F.col("start").alias("c_start"))
    within = F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("uid") == F.col("c_uid")) & (F.col("inside") == F.col("c_start"))
    rest = _later(keys.where("inside <> -1").join(found, within, "left_anti"))
    return _verified(docs, whole.unionByName(rest))


def pairs(lines: list[str]) -> list[tuple[int, int]]:
    """(start, n_lines) of what is looked up: two neighbouring lines that are not both blank, blank lines up to the next other one, long lines."""
    out, blank, opened = [], [not x.strip() for x in lines], 0
    for i, x in enumerate(lines):
        if not blank[i]:
            if i and blank[i - 1] and i - opened > 1:
                out.append((opened, i - opened + 1))
            if len(x) >= 2 * _LONG - 1 and len(x.split()) >= _LONG:
                out.append((i, 1))
        elif not (i and blank[i - 1]):
            opened = i
        if i + 1 < len(lines) and not (blank[i] and blank[i + 1]):
            out.append((i, 2))
    return out


def _keys(docs: DataFrame) -> DataFrame:
    """(doc, uid, start, n_lines, hash, inside) of all ``chunks`` (inside is -1) and all ``pairs`` (the start of the chunk that holds them, else -2)."""

    def run(batch):
        out = {"doc": batch["doc"], "uid": batch["uid"], "keys": []}
        for text in batch["text"]:
            lines = text.split("\n")
            of = np.full(len(lines) + 1, -2)
            units = []
            for a, n in chunks(lines) if len(lines) > 1 else []:
                of[a : a + n] = a
                units.append((a, n, -1))
            units += [(a, n, int(of[a]) if of[a] == of[a + n - 1] else -2) for a, n in pairs(lines)]
            out["keys"].append([{"start": a, "n_lines": n, "hash": xxhash.xxh3_64_intdigest("\n".join(lines[a : a + n]).encode("utf-8", "replace")) - 2**63, "inside": c} for a, n, c in units])
        return out

    rows = arrow_map(_identified(docs).where("text <> ''"), "doc long, uid long, keys array<struct<start:int,n_lines:int,hash:long,inside:int>>", run)
    return rows.select("doc", "uid", F.inline("keys"))


def _later(keys: DataFrame) -> DataFrame:
    """Keys whose hash occurs earlier: (doc, uid, start, n_lines, first_), where it occurs first."""
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "uid", "start")
    first = keys.groupBy("hash").agg(F.min(place).alias("first_"), F.max(place).alias("last_")).where("first_ <> last_").drop("last_")
    return keys.join(store(first, "first"), "hash").where(place != F.col("first_")).select("doc", "uid", "start", "n_lines", "first_")


def _runs(found: list[dict]) -> list[tuple]:
    """Finds of one document that continue each other in the same earlier place, joined; runs inside others are left out."""
    ways: dict[tuple, list] = {}
    for f in sorted(found, key=lambda f: (f["start"], f["n_lines"])):
        way = ways.setdefault((f["doc"], f["uid"], f["at"] - f["start"]), [])
        if way and f["start"] <= way[-1][1]:
            way[-1][1] = max(way[-1][1], f["start"] + f["n_lines"])
        else:
            way.append([f["start"], f["start"] + f["n_lines"]])
    out, reach = [], -1
    for a, end, doc, uid, shift in sorted(((a, b, *k) for k, way in ways.items() for a, b in way), key=lambda r: (r[0], -r[1])):
        if end > reach:
            out.append((a, end - a, doc, uid, a + shift))
            reach = end
    return out


def _apart(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for start, n in sorted((s["start"], s["n_lines"]) for s in spans):
        if out and start <= out[-1]["start"] + out[-1]["n_lines"]:
            out[-1]["n_lines"] = max(out[-1]["n_lines"], start + n - out[-1]["start"])
        else:
            out.append({"start": start, "n_lines": n})
    return out


def _verified(docs: DataFrame, later: DataFrame) -> DataFrame:
    per = later.groupBy("doc", "uid").agg(F.collect_list(F.struct("start", "n_lines", F.col("first_.doc").alias("doc"), F.col("first_.uid").alias("uid"), F.col("first_.start").alias("at"))).alias("found"))

    def joined(batch):
        out = {"doc": batch["doc"], "uid": batch["uid"], "runs": []}
        for found in batch["found"]:
            out["runs"].append([dict(zip(("start", "n_lines", "of_doc", "of_uid", "of_start"), r, strict=True)) for r in _runs(found)])
        return out

    runs = arrow_map(per, "doc long, uid long, runs array<struct<start:int,n_lines:int,of_doc:long,of_uid:long,of_start:int>>", joined)
    runs = store(runs.select("doc", "uid", F.inline("runs")), "runs")
    key = F.struct("of_doc", "of_uid", "of_start", "n_lines").alias("key")
    copies = runs.select("doc", "uid", "start", "n_lines", key, F.lit(False).alias("is_first"))
    firsts = runs.select("of_doc", "of_uid", "of_start", "n_lines").distinct().select(F.col("of_doc").alias("doc"), F.col("of_uid").alias("uid"), F.col("of_start").alias("start"), "n_lines", key, F.lit(True).alias("is_first"))
    wanted = copies.union(firsts).groupBy("doc", "uid").agg(F.collect_list(F.struct("start", "n_lines", "key", "is_first")).alias("places"))

    def cut(batch):
        out = {n: [] for n in ("doc", "uid", "start", "n_lines", "key", "is_first", "chunk")}
        for doc, uid, text, places in zip(batch["doc"], batch["uid"], batch["text"], batch["places"], strict=True):
            lines = text.split("\n")
            for p in places:
                for name, value in (("doc", doc), ("uid", uid), *p.items(), ("chunk", "\n".join(lines[p["start"] : p["start"] + p["n_lines"]]))):
                    out[name].append(value)
        return out

    rows = _identified(docs).alias("d").join(store(wanted, "wanted").alias("w").hint("merge"), _same("d", "w")).select("d.doc", "d.uid", "d.text", "w.places")
    kind = "struct<of_doc:long,of_uid:long,of_start:int,n_lines:int>"
    texts = store(arrow_map(rows, f"doc long, uid long, start int, n_lines int, key {kind}, is_first boolean, chunk string", cut), "texts")
    texts = texts.withColumn("key", F.xxhash64("key"))
    origin = texts.where("is_first").groupBy("key").agg(F.first("chunk").alias("first_chunk"))
    same = texts.where("NOT is_first").join(origin, "key").where("chunk = first_chunk")
    spans = same.groupBy("doc", "uid").agg(F.collect_list(F.struct("start", "n_lines")).alias("spans"))
    apart = arrow_map(spans, "doc long, uid long, spans array<struct<start:int,n_lines:int>>", lambda b: {**b, "spans": [_apart(x) for x in b["spans"]]})
    return apart.select("doc", "uid", F.inline("spans"))


def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for text, spans in zip(texts, gone, strict=True):
        if text is None or spans is None:
            out.append(text)
            continue
        lines, keep, at = text.split("\n"), [], 0
        for start, n in sorted((int(s["start"]), int(s["n_lines"])) for s in spans):
            keep += lines[at:start]
            at = start + n
        out.append("\n".join(keep + lines[at:]))
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``spans``, or else ``repeated_chunks``, cut out of ``text``, plus n_lines_ and n_removed_ (lines)."""
    spans = (repeated_chunks(docs) if spans is None else spans).groupBy("doc", "uid").agg(F.collect_list(F.struct("start", "n_lines")).alias("gone"))
    doc, uid, gone = fresh(docs, "gone_doc", "gone_uid", "gone_spans")
    spans = store(spans, "gone").toDF(doc, uid, gone)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("doc_id", "text") == F.col(uid))
    rows = docs.join(spans.hint("merge"), same, "left")
    hit = F.col(gone).isNotNull()
    text = F.when(hit, F.pandas_udf(_without, "string")(F.when(hit, F.col("text")), F.col(gone))).otherwise(F.col("text"))
    n = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long")
    removed = F.coalesce(F.aggregate(gone, F.lit(0).cast("long"), lambda s, g: s + g["n_lines"]), F.lit(0).cast("long"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines_", "n_removed_")], n.alias("n_lines_"), removed.alias("n_removed_"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, with repeated passages removed and ``n_chars`` brought up to date where there is one."""
    held = dict(zip(("n_lines_", "n_removed_"), fresh(docs, "n_lines_", "n_removed_"), strict=True))  # the table's own columns of these names
    out = dedup_lines(docs.withColumnsRenamed(held), repeated_chunks(docs)) if set(held) & set(docs.columns) else dedup_lines(docs, repeated_chunks(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed_") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(held[c]).alias(c) if c in held else F.col(c) for c in docs.columns])
