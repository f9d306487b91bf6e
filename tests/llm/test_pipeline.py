"""The pipeline's stages on a small table: contracts between stages, and what each stage decides."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from riverglass.llm import lines, simhash
from riverglass.llm.common import read, store


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def pairs_of(rows):
    """(similar at 0.8 by sets of five-word shingles, (text, text)) of all pairs of different rows."""
    sets = [shingles(t) for _, t in rows]
    return [((i, j) if 5 * len(a & b) >= 4 * len(a | b) else None, (rows[i][1], rows[j][1])) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])]


def kept_of(rows):
    """One (doc_id, text) of each component of similar rows: that with the smallest id, null last, by comparing all pairs."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for pair, _ in pairs_of(rows):
        if pair:
            root[find(pair[0])] = find(pair[1])
    parts = {}
    for i, row in enumerate(rows):
        parts.setdefault(find(i), []).append(row)
    return [min(part, key=lambda r: (r[0] is None, r[0] or 0)) for part in parts.values()]


def test_stages(spark, small):
    docs = read(spark, small, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "mixing", "sentencepiece"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, store(stage(spark, docs, small), name)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "line_dedup":
            gone = lines.repeated_chunks(before).agg({"n_lines": "sum"}).first()[0]
            size = lambda df: df.selectExpr("sum(length(text) - length(replace(text, '\n')) + 1)").first()[0]
            emptied = docs.where("text = ''").count() - before.where("text = ''").count()
            assert docs.count() == before.count() and gone and size(docs) == size(before) - gone + emptied
        if name == "simhash":
            assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(kept_of([(r.doc_id, r.text) for r in before.collect()]))
    assert docs.select("doc_id").distinct().count() <= before.select("doc_id").distinct().count()
    assert set(docs.columns) == {"doc_id", "rank", "ids", "n_pieces", "log_prob", "inclusion"}


def test_run_equals_the_stages(spark, small):
    a = corpus_pipeline.run(spark, small).select("doc_id", "rank", "n_pieces").collect()
    b = corpus_pipeline.run(spark, small).select("doc_id", "rank", "n_pieces").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


def test_near_copies_go_from_the_pipeline(spark, make, small):
    rng = random.Random(15)
    rows = []
    for k in range(30):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 200]))]
        for i in range(5):
            copy = list(words)
            for _ in range(rng.randrange(1 + i * len(words) // 100)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99999)}"
            rows.append((10 * k + i, " ".join(copy)))
    rows += [(900, None), (901, ""), (None, "no id at all"), (902, "short"), (903, "Short")]
    rows += [(950, "one id"), (950, "one id"), (950, "and two quite different texts of it")]
    got = corpus_pipeline.dedup_documents(spark, make(rows), small)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(kept_of(rows), key=repr)
    linked = [(a, b) for i, (a, b) in pairs_of(rows) if i]
    far = sum((simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() > 3 for a, b in linked)
    assert got.columns == make(rows).columns and len(linked) > far > 20
    assert corpus_pipeline.dedup_documents(spark, make(rows).limit(0), small).count() == 0


def test_large_groups_of_near_copies(spark, make):
    """A group of near copies that is far larger than a block, one of strangers that share a passage, and clashing names."""
    rng = random.Random(18)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    shared = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + i, shared + " " + " ".join(f"q{i}w{rng.randrange(10**6)}" for _ in range(9 + i % 30))) for i in range(200)]
    docs = make(rows).selectExpr("*", "'x' AS u1", "'y' AS kept_u2")
    got = simhash.keep_one_similar(docs)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(kept_of(rows)) and got.columns == docs.columns


def test_long_texts_in_common_meet_once(spark, make):
    """Two texts share hundreds of rare shingles: one group stands for all that the same sets hold."""
    words = [f"w{i}" for i in range(1500)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:1000] + [f"y{i}" for i in range(500)])), (3, " ".join(words[:300] + [f"z{i}" for i in range(900)]))]
    groups = simhash._prefixes(simhash.shingle_sets(make(rows), 5), 0.8).collect()
    held = {}
    for r in groups:
        held.setdefault(r.hash, set()).add(r.id)
    assert len(held) == len({frozenset(ids) for ids in held.values()}) <= 4
    assert sum({r.hash: r.copies for r in groups}.values()) > 50


def test_parity_bits_tell_large_sets_apart(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for n, m, common in ((3000, 3000, 2250), (1000, 1100, 1000), (60, 60, 50), (0, 0, 0), (20000, 18000, 17000)):
        x = rng.integers(0, 2**63, n + m - common).astype(np.uint64)
        rows.append((len(rows), simhash._parity(x[:n]).tolist(), simhash._parity(x[n - common :]).tolist()))
        want.append(n + m - 2 * common)
    got = [r.d for r in spark.createDataFrame(rows, "i int, a array<long>, b array<long>").select("i", simhash._bits_apart(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert all(g <= w and (w - g) % 2 == 0 for g, w in zip(got, want, strict=True))
    assert got[0] > 6000 / 9  # Jaccard 0.6: a similarity of 0.8 is ruled out
