"""Conversation repair against exhaustive search, a plain recursion, and a plain version of the whole query."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from riverglass.llm import conversations, queries
from riverglass.llm.conversations import GOALS, cheapest

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(codes):
    """Every edit string with up to two insertions in a row."""
    best = (10**9, "")
    rows = [("D",) if c == "X" else ("D", "K", "R") for c in codes]
    for letters in itertools.product(*rows):
        for gaps in itertools.product(range(3), repeat=len(codes) + 1):
            audit = "".join("I" * g + x for g, x in zip(gaps, [*letters, ""], strict=True))
            roles, cost, i = "", 0, 0
            for x in audit:
                speaker = "a" if roles.endswith("u") else "u"
                if x == "I":
                    roles, cost = roles + speaker, cost + 5
                    continue
                if x == "D":
                    cost += 2
                else:
                    cost += (x == "R") + 5 * codes[i].isupper()
                    roles += codes[i].lower() if x == "K" else speaker
                i += 1
            body = roles.removeprefix("s")
            if (body or not roles) and body == "ua" * (len(body) // 2):
                best = min(best, (cost, audit))
    return best


def recursion(codes, start, goals):
    n = len(codes)

    @cache
    def go(i, s, inserted):
        found = [(0, "")] if i == n and s in goals else []
        speaker = 3 if s == 2 else 2
        if inserted < 2:
            found.append((lambda r: (r[0] + 5, "I" + r[1]))(go(i, speaker, inserted + 1)))
        if i < n:
            c, more = codes[i].lower(), 5 * codes[i].isupper()
            ways = [("D", 2, s)]
            if c != "x":
                ways.append(("R", 1 + more, speaker))
                if c == "s" and s == 0 or c == "u" and s != 2 or c == "a" and s == 2:
                    ways.append(("K", more, {"s": 1, "u": 2, "a": 3}[c]))
            found += [(cost + r[0], x + r[1]) for x, cost, t in ways for r in [go(i + 1, t, 0)]]
        return min(found, default=(float("inf"), ""))

    return go(0, start, 0)


def test_search_is_exhaustive():
    for n in range(4):
        for codes in itertools.product("XsuaoSUA" if n < 3 else "XsuaU", repeat=n):
            assert cheapest("".join(codes)) == exhaustive(codes)


def test_search_matches_recursion():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.choice([1, 3, 8, 20, 40, 70])
        codes = "".join(rng.choice("XsuaoSUAO") for _ in range(n)) if rng.random() < 0.5 else "".join("X" if rng.random() < 0.05 else c for c in "s" * rng.randrange(2) + "ua" * (n // 2) if rng.random() > 0.1)
        start, goals = rng.randrange(4), rng.choice([GOALS, (0,), (1,), (2,), (3,)])
        got, want = cheapest(codes, start, goals), recursion(codes, start, goals)
        assert got == want or got[0] == want[0] == float("inf")


def test_bounds_never_exceed_the_cost():
    rng = random.Random(2)
    for _ in range(50):
        codes = "".join(rng.choice("XsuaUA") for _ in range(50))
        bounds = conversations.suffix_bounds(codes, GOALS)
        assert all(bounds[i][s] <= recursion(codes[i:], s, GOALS)[0] for i in range(0, 51, 5) for s in range(4))


def plain(rows):
    """One conversation's rows (turn, role, text), already damaged, to the contract's values."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen, codes = [], set(), ""
    for _, role, text in rows:
        shown = text.strip(SPACE)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        c = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "X" if fault in ("blank", "duplicate") else c.upper() if fault else c
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = recursion(codes, 0, GOALS)
    out, i, last = [], 0, ""
    for x in audit:
        speaker = "assistant" if last == "u" else "user"
        if x == "I":
            out.append(f"{speaker}:")
            last = speaker[0]
            continue
        if x != "D":
            role = rows[i][1] if x == "K" else speaker
            out.append(f"{role}:{rows[i][2]}")
            last = role[0]
        i += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversation(rng, n):
    roles = ["system"] * rng.randrange(2) + ["user", "assistant"] * n
    texts = ["Yes.", "No!", "why?", "cut off", " \t", "", None, "é 🙂.", "ends \n", "Fine. \n", "same."]
    rows = [(t, r if rng.random() < 0.9 else rng.choice(["tool", "", None, "User", "system", "sys"]), f"{t} {rng.choice(texts)}" if rng.random() < 0.8 else rng.choice(texts)) for t, r in enumerate(roles[: rng.randrange(1, 2 * n + 2)])]
    return [(None if rng.random() < 0.05 else t if rng.random() < 0.95 else t + 1, r, x) for t, r, x in rows if rng.random() < 0.95]


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = "".join(x for x in text if x not in ".!?")
        out += [(c, t, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def table(rng):
    rows = [(c, *r) for c in range(60) for r in conversation(rng, rng.choice([1, 2, 4]))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, 2, "assistant", "Hi."), (70, None, None, None), (71, None, "user", "x" * 50_000 + ".")]
    rows += [(80, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(40)] + [(81, *r) for r in conversation(rng, 30)]
    dropped = next(t for t in range(10**6) if zlib.crc32(f"90:{t}".encode()) % 20 == 0)
    return [*rows, (90, dropped, "user", "all that there is.")]


@pytest.mark.parametrize("segment", [1024, 5])
def test_repair_of_a_table(spark, segment):
    rows = damaged(table(random.Random(segment)))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("seg", "codes", "audit", "pos", "last")})
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(df, segment).collect()}
    assert got == {c: plain([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert conversations.repair(df.limit(0)).count() == 0


def test_query_matches_plain_version(spark, tmp_path):
    rows = table(random.Random(9))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    after = damaged(rows)
    assert got == {c: plain([r[1:] for r in after if r[0] == c]) for c in {r[0] for r in rows}}
    assert got[90] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
