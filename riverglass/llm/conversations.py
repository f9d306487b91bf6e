"""Operator 12: conversations brought to the order (system?) (user assistant)* by the cheapest edits, found by branch and bound.

Rows stand in order of turn (nulls first), then role, then text. A row is faulty if it is blank, repeats an earlier row's role and text, or is truncated (its last visible
character is none of ``.!?``); the first of these counts. Edits: D deletes (2; the only choice for blank and repeated rows), I inserts an empty row of
either speaker (5), K keeps (0), R gives the row to a speaker (1); a truncated row that stays costs 5 more. Of the cheapest
edits that leave role initials ``(s?(ua)+)?`` the one whose letters come first in ASCII is taken.

Spark sorts each conversation once, by windows over rows, and packs ``segment`` rows at a time into one row of codes. A segment is searched for each state in which it may begin
and end (nothing yet, after the system row, after a user, after an assistant): depth first with an explicit stack, edits in order of their letters, so that equal costs are met in ASCII order.
A suffix's lower bound is exact within blocks of 16 rows and free at their borders; a dive along the bounds gives the first incumbent (cost, audit); each (row, state) remembers the
least (cost, audit) that reached it, and a prefix that is no better is dropped; the search ends when the stack is empty or the incumbent meets the
bound. Nearly all conversations are one segment. Longer ones are composed from their segments' results by state, and their text is hashed as a stream of segments, so
no task holds more of a conversation than its letters and one segment's texts.

Defined cases: null roles and texts count as one space, null turns come first, a null conversation id is a conversation; a role that begins with none of s, u, a (or is empty) can't be kept; rows that are
equal in turn, role and text are repeats; texts may be of any length; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, store

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
GOALS = (START, ASSISTANT)
DELETE, INSERT, REROLE, TRUNCATED, NEVER = 2, 5, 1, 5, float("inf")
_SPACE = r"\x20\x09-\x0D"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def repair(rows: DataFrame, segment: int = 1024) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    parts = store(segments(rows, segment), "segments")
    kind = parts.schema["conv_id"].dataType.simpleString()
    solved = arrow_map(parts.select("conv_id", "seg", "last", "codes"), f"conv_id {kind}, seg long, options array<struct<start:int,stop:int,cost:long,audit:string>>", _options)
    ways = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "options"))).alias("parts"))
    chosen = arrow_map(ways, f"conv_id {kind}, chosen array<struct<seg:long,start:int,cost:long,audit:string>>", _chosen).select(F.col("conv_id").alias("of"), F.inline("chosen"))
    chosen = store(chosen.withColumnRenamed("seg", "at"), "chosen")
    both = parts.join(chosen, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("seg") == F.col("at")))
    columns = ["conv_id", "seg", "low", "high", "turns", *_COUNTS, "cost", "audit"]
    types = dict(parts.dtypes) | {"cost": "bigint", "audit": "string"}
    texts = arrow_map(both.select(*columns, "start", "pieces"), ", ".join(f"{c} {types[c]}" for c in columns) + ", lines string", lambda b: _applied(b, columns), rows=64)
    ordered = texts.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    out = T._parse_datatype_string(f"conv_id {kind}, gaps long, {', '.join(f'{c} long' for c in _COUNTS)}, cost long, audit string, repaired_sha256 string")
    arrow = to_arrow_schema(out)
    return ordered.mapInArrow(lambda batches: _digests(batches, arrow), out)


def segments(rows: DataFrame, size: int) -> DataFrame:
    """conv_id, seg, last (of its conversation), codes (a letter a row), pieces (pos, role, text), low, high and new turns, counts of faults and of illegal neighbours."""
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({
        "pos": F.row_number().over(w).cast("long"), "last": F.lead(F.lit(1)).over(w).isNull(), "initial": initial, "before": F.lag(initial).over(w),
        "new": (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(w))).cast("long"),
    })
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    fault = F.when(~F.col("text").rlike(f"[^{_SPACE}]"), "blank").when(again, "duplicate").when(F.col("text").rlike(rf"[^.!?{_SPACE}][{_SPACE}]*\z"), "truncated").otherwise("")
    rows = rows.withColumn("fault", fault)
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "X").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    count = lambda c: F.sum(c.cast("long"))
    return rows.withColumn("code", code).groupBy("conv_id", F.floor((F.col("pos") - 1) / size).alias("seg")).agg(
        F.bool_or("last").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda r: r["code"]), "").alias("codes"),
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("pieces"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum("new").alias("turns"),
        *[count(F.col("fault") == c).alias(c) for c in _COUNTS[:3]], count(illegal).alias("illegal"),
    )


def _speaker(state: int) -> int:
    """The state after the speaker whose turn it is."""
    return ASSISTANT if state == USER else USER


def _edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that take up a row of this code, in ASCII order."""
    found = [("D", DELETE, state)]
    if code != "X":
        more = TRUNCATED if code.isupper() else 0
        after = {"s": SYSTEM if state == START else None, "u": USER if state != USER else None, "a": ASSISTANT if state == USER else None}.get(code.lower())
        if after is not None:
            found.append(("K", more, after))
        found.append(("R", REROLE + more, _speaker(state)))
    return found


EDITS = {code: [_edits(code, s) for s in STATES] for code in "XsuaoSUAO"}


def suffix_bounds(codes: str, goals: tuple[int, ...], block: int = 16) -> list[list[float]]:
    """For each row and state a cost that no way to the end undercuts: exact up to the next border of ``block`` rows, there the least of all states."""

    def inserted(costs):  # least over no, one, two insertions
        out = list(costs)
        for _ in range(2):
            out = [min(out[s], INSERT + out[_speaker(s)]) for s in STATES]
        return out

    n = len(codes)
    bounds = [[]] * n + [inserted([0 if s in goals else NEVER for s in STATES])]
    for i in range(n - 1, -1, -1):
        here = inserted([min(cost + bounds[i + 1][after] for _, cost, after in EDITS[codes[i]][s]) for s in STATES])
        bounds[i] = [min(here)] * 4 if i and i % block == 0 else here
    return bounds


def cheapest(codes: str, start: int = START, goals: tuple[int, ...] = GOALS) -> tuple[float, str]:
    """(cost, audit) of the cheapest edits from ``start`` to one of ``goals``, the ASCII-least of them; an infinite cost if there are none."""
    n, bounds = len(codes), suffix_bounds(codes, goals)
    best = _dive(codes, start, goals, bounds)
    reached: dict[tuple[int, int], tuple[float, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if cost + bounds[i][state] > best[0] or (i, state) in reached and reached[i, state] <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == n and state in goals and (cost, audit) < best:
            best = (cost, audit)
            if cost <= bounds[0][start]:  # prefixes come in ASCII order: none is cheaper, and none as cheap comes first
                break
        steps = [(i + 1, after, cost + c, audit + letter) for letter, c, after in EDITS[codes[i]][state]] if i < n else []
        steps.insert(1, (i, _speaker(state), cost + INSERT, audit + "I"))
        stack += reversed(steps)
    return best


def _dive(codes: str, state: int, goals: tuple[int, ...], bounds: list[list[float]]) -> tuple[float, str]:
    """The first incumbent: at each row the edit that looks cheapest by the bounds; two insertions at most stand together."""
    i, cost, audit = 0, 0, ""
    while True:
        if i == len(codes) and state in goals:
            return cost, audit
        steps = [(c + bounds[i + 1][after], letter, c, after) for letter, c, after in EDITS[codes[i]][state]] if i < len(codes) else []
        if not audit.endswith("II"):
            steps.append((INSERT + bounds[i][_speaker(state)], "I", INSERT, _speaker(state)))
        if not steps:
            return NEVER, ""
        _, letter, c, state = min(steps)
        cost, audit, i = cost + c, audit + letter, i + (letter != "I")


def _options(batch: dict) -> dict:
    """A segment's results by the states it begins and ends in; the first begins with nothing, the last ends in a goal."""
    out = []
    for seg, last, codes in zip(batch["seg"], batch["last"], batch["codes"], strict=True):
        ways = [(a, b, cheapest(codes, a, (b,))) for a in (STATES if seg else (START,)) for b in (GOALS if last else STATES)]
        out.append([{"start": a, "stop": b, "cost": int(cost), "audit": audit} for a, b, (cost, audit) in ways if cost < NEVER])
    return {"conv_id": batch["conv_id"], "seg": batch["seg"], "options": out}


def _chosen(batch: dict) -> dict:
    """The cheapest sequence of the segments' options, ties to the ASCII-least audit."""
    out = []
    for parts in batch["parts"]:
        best = {START: (0, "", [])}
        for part in parts:
            after: dict[int, tuple] = {}
            for o in part["options"]:
                if o["start"] in best:
                    cost, audit, way = best[o["start"]]
                    new = (cost + o["cost"], audit + o["audit"], [*way, (part["seg"], o["start"], o["cost"], o["audit"])])
                    after[o["stop"]] = min(after.get(o["stop"], new), new, key=lambda x: x[:2])
            best = after
        way = min((best[s] for s in GOALS if s in best), key=lambda x: x[:2])[2]
        out.append([dict(zip(("seg", "start", "cost", "audit"), step, strict=True)) for step in way])
    return {"conv_id": batch["conv_id"], "chosen": out}


def _applied(batch: dict, columns: list[str]) -> dict:
    """Each segment's repaired ``role:text`` lines; null where none is left."""
    lines = []
    for state, audit, pieces in zip(batch["start"], batch["audit"], batch["pieces"], strict=True):
        rows, found = iter(pieces), []
        for letter in audit:
            row = next(rows) if letter != "I" else {"text": ""}
            if letter == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[row["role"][0]]
                found.append(f"{row['role']}:{row['text']}")
            elif letter != "D":
                state = _speaker(state)
                found.append(f"{'user' if state == USER else 'assistant'}:{row['text']}")
        lines.append("\n".join(found) if found else None)
    return {c: batch[c] for c in columns} | {"lines": lines}


def _digests(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted segments folded into one row a conversation; the hash is carried from one segment and batch to the next."""
    now, told = None, False

    def closed(c):
        gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"]
        return {"conv_id": c["conv_id"], "gaps": gaps, "cost": c["cost"], "audit": "".join(c["audit"]), "repaired_sha256": c["hash"].hexdigest()} | {k: c[k] for k in _COUNTS}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or r["conv_id"] != now["conv_id"]:
                if now:
                    out.append(closed(now))
                now, told = r | {"audit": [], "hash": hashlib.sha256()}, False
            else:
                for k in ("turns", "cost", *_COUNTS):
                    now[k] += r[k]
                now |= {k: f(x for x in (now[k], r[k]) if x is not None) if now[k] is not None or r[k] is not None else None for k, f in (("low", min), ("high", max))}
            now["audit"].append(r["audit"])
            if r["lines"] is not None:
                now["hash"].update((("\n" if told else "") + r["lines"]).encode())
                told = True
        yield pa.RecordBatch.from_pylist(out, schema=arrow)
    if now:
        yield pa.RecordBatch.from_pylist([closed(now)], schema=arrow)
