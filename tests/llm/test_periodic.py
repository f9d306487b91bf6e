"""Periodic runs against brute force: tiles alone on random words, and whole tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from riverglass.llm import periodic, queries


def brute(words):
    """(start, length, period) of every run, by comparing all words at all distances."""
    n, least = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q) and i > s:
                least.setdefault((s, i - s + q), q)
            i = max(i, s + 1)
    return sorted((s, n, q) for (s, n), q in least.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def tiled(words):
    """The same from the tiles, stitched here."""
    text = b" ".join(b"%d" % w for w in words)
    batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "text": pa.array([text], pa.binary())})
    parts = {r for out in periodic._solved(periodic._tiles([batch])) for r in zip(*(out.column(c).to_pylist() for c in ("period", "s", "e")), strict=True)}
    whole = []
    for p, s, e in sorted(parts):
        if whole and whole[-1][0] == p and s <= whole[-1][2]:
            whole[-1][2] = max(whole[-1][2], e)
        else:
            whole.append([p, s, e])
    return sorted((s, e - s + p, p) for p, s, e in whole if e - s + p >= max(6, 4 * p))


def repetitive(rng, n):
    words = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 10:
            a, p, size = rng.randrange(n), rng.randrange(1, max(2, n // 4)), rng.randrange(1, n)
            for i in range(a + p, min(n, a + size)):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("stride", [2048, 16])
def test_tiles_find_every_run(monkeypatch, stride):
    monkeypatch.setattr(periodic, "_STRIDE", stride)
    rng = random.Random(stride)
    for _ in range(400):
        words = repetitive(rng, rng.choice([0, 3, 7, 20, 60, 200, 400]))
        assert tiled(words) == brute(words)


def test_z_values():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        z = periodic.z_values(s, 20)
        assert z[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, min(20, len(s)))]


def odd_texts(rng):
    long_ = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    long_[9000:27_000] = [long_[9000 + i % 4100] for i in range(18_000)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a a a a a", "a a a a a a", "x ha ha ha ha ha ha ha y", " ".join(long_), "é é é\x1cé 🙂 " * 9, "a  b\ta\nb a b a b a b", "z " * 700]
    texts += [" ".join(map(str, repetitive(rng, rng.choice([10, 100, 300])))) for _ in range(30)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[6]), (50, texts[6]), (50, texts[6]), (7, "other text of the same id")]


def test_runs_of_a_table(make):
    rows = odd_texts(random.Random(5))
    df = make(rows).withColumnRenamed("size", "runs").withColumnRenamed("fp", "collapsed")
    out = periodic.runs(df)
    assert out.columns == [*df.columns, "runs_", "collapsed_"]
    got = sorted(((r.doc_id, r.text, [tuple(x) for x in r.runs_], r.collapsed_) for r in out.collect()), key=repr)
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        found = brute(words) if len(words) < 20_000 else [(9000, 18_000, 4100)]
        want.append((i, t, found, collapsed(words, found).decode()))
    assert got == sorted(want, key=repr)


def test_no_rows(make):
    assert periodic.runs(make([]).limit(0)).count() == 0


def test_query_matches_brute_force(spark, make, tmp_path):
    rows = odd_texts(random.Random(6))[:-6] + [(i, " ".join(random.Random(i).choices("abcdefghij", k=i % 90))) for i in range(100, 300)]
    rows = [r for r in rows if len(r[1] or "") < 20_000]
    make(rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, t in rows:
        words = (t or "").encode().split()
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
            planted += 1
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4))
        listing = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256(listing.encode()).hexdigest() and r.collapsed_sha256 == hashlib.sha256(collapsed(words, found)).hexdigest()
    assert planted > 5
