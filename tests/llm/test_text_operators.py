"""Document operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riverglass.llm import lines, mixing, pii, repeats, sentencepiece, simhash, toxicity
from riverglass.llm.common import clear, connected_components, hash_sample, join_counted, read, running_totals, shared_dir, store

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n, newline=0.1):
    return "".join(rng.choice(WORDS) + ("\n" if rng.random() < newline else " ") for _ in range(n))


def odd_rows(rng):
    base = prose(rng, 300)
    long_ = prose(rng, 30_000)
    return [(1, base, "a"), (2, base, "a"), (3, base + " tail", "b"), (4, None, "a"), (5, "", None), (6, " \n\t", "b"), (7, "one", "c"), (8, long_, "hot"), (9, long_[:-7], "hot"), (None, "no id at all", "c"), (10, "x" * 5000, "hot"), (11, "twice the same row", "c"), (11, "twice the same row", "c"), (12, "é梦🙂 " * 200, "c")]


# ---- shared helpers


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i, rng.randrange(10)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {r.o: r.before for r in running_totals(df, ["g"], ["o"], "v", "before").collect()}
    sums, want = Counter(), {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        want[o], sums[g] = sums[g], sums[g] + v
    assert got == want
    assert running_totals(df.limit(0), ["g"], ["o"], "v", "before").count() == 0


def test_intermediate_tables_can_be_cleared(spark):
    df = store(spark.range(3), "gone")
    assert df.count() == 3
    clear(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/riverglass"))


def test_samples_are_bounded(spark):
    df = spark.range(20_000)
    n = hash_sample(df, "id", 1000, "a").count()
    assert 700 < n <= 1000 and hash_sample(df, "id", 20_000, "a").count() == 20_000


@pytest.mark.parametrize("share", [2, 10, 4096])
def test_hot_keys_are_joined_apart(spark, share):
    rng = random.Random(share)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(300)}", rng.randrange(3), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b long, i long")
    named = store(df.where("a <> 'k7'").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("i").alias("least")), "named")
    out = join_counted(df, named, ["a", "b"], "n", share)
    assert out.columns == ["a", "b", "i", "least"]
    least = {}
    for a, b, i in rows:
        least.setdefault((a, b), i)
    assert sorted(map(tuple, out.collect())) == sorted((a, b, i, least[a, b]) for a, b, i in rows if a != "k7")
    assert join_counted(df.limit(0), named.limit(0), ["a", "b"], "n").count() == 0


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(-5, 3), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 1 mixing


def check_mix(rows, weights=(1, 2, 3)):
    sizes, targets = {}, {}
    for r in rows:
        sizes[r.source] = r.source_size
        targets[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while total:
        level = (total - sum(3 * sizes[s] for s in full)) / max(1, sum(w[s] for s in w if s not in full))
        new = {s for s in w if s not in full and w[s] * level > 3 * sizes[s]}
        if not new:
            break
        full |= new
    for s in order:
        want = 3 * sizes[s] if s in full else w[s] * level
        assert abs(targets[s] - want) < 1e-6 * max(1, want)
        taken = sum(r.taken for r in rows if r.source == s)
        assert abs(taken - targets[s]) <= 0.5 or not sizes[s]
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_mix_targets_and_cuts(make):
    rows = odd_rows(random.Random(3))
    df = make(rows)
    got = mixing.mix_plan(df).collect()
    assert sorted(r.size for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    check_mix(got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_plan(df).collect()), key=repr)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    plan = Counter()
    for r in got:
        plan[r.source] += r.taken
    assert all(abs(words[s] - plan[s]) <= 2 for s in plan)  # rows that repeat share what they take


def test_mix_of_nothing(make):
    assert mixing.mix_plan(make([]).limit(0)).count() == 0
    got = mixing.mix_plan(make([(1, None), (2, "")])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


# ---- 3 personal data

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = [c for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn("".join(digits))):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(4)
    parts = ["a", "@", ".", "1", "2", "9", "-", "+", " ", "(", "_", "b.c", "4111111111111111", "1.2.3.4", "x@y.z", "256.1.1.1", "+1 (212) 555-0100", "é"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("1" * 50_000 + "." + "0" * 6000 + "1.2.3") == [("ip", 0, 0)][:0]


def test_detection_adds_spans_and_keeps_base_ones(make):
    rows = [(1, "write to anna [at] example [dot] org today"), (2, "call +1 (212) 555-0100 or mail a@b.org"), (3, None), (4, ""), (5, "plain words only " * 5000), (6, "tel (030) 555-4433 please"), (6, "tel (030) 555-4433 please")]
    df = make(rows)
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    for doc, text in rows:
        r, base = got[doc], brute_base(text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    assert "email:9:36" in got[1].spans and "phone" in got[6].spans and got[5].spans == ""
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[2] == "call [phone] or mail [email]"
    assert pii.detect(df.limit(0)).count() == 0


def test_generators_search_every_text_that_they_match():
    rng = random.Random(16)
    parts = ["john", "a.b", "example", "com", " at ", "at", "AT", " ", "[", "]", "(", ")", " dot ", "dot", ".", "1", "22", "333", "4444", ":", "-", "[.]", " . ", "fe"]
    texts = ["write to john at example.com now", "fe80:1:22:333:4444", "1 . 22 . 33 . 44", "4444 4444-4444", "22 333"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 12))) for _ in range(60_000)]
    for _, needed, pattern in pii.GENERATORS:
        hit = [t for t in texts if pattern.search(t)]
        assert hit and all(needed.search(t) for t in hit)
    assert ("email", 9, 28) in pii.proposals(texts[0])


def test_boosting_learns_and_is_calibrated():
    x, y = pii.examples([f"word{c}" for c in "abcdefg"] + WORDS + ["alpha", "beta"], n=3000)
    cut = 2000
    model = pii.Boosted().fit(x[:cut], y[:cut])
    raw = model.raw(x[cut:])
    at = pii.calibrated_threshold(raw, y[cut:], 0.98)
    assert y[cut:][raw >= at].mean() >= 0.97 and (raw >= at)[y[cut:] == 1].mean() > 0.8


@pytest.fixture(scope="module")
def trained(spark, small):
    """A model fitted in the words of the test tables, which hold letters of many scripts."""
    return pii.fit(read(spark, small, "documents"))


def test_generated_forms_are_found_in_the_tables_words(spark, small, trained):
    model, thresholds = trained
    words = sorted({w for r in read(spark, small, "documents").collect() for w in (r.text or "").split()[:100]})
    x, y = pii.examples(words, seed=99)
    raw = model.raw(x)
    for k, kind in enumerate(pii.KINDS):
        own, passed = x[:, 0] == k, raw >= thresholds[kind]
        assert passed[own & (y == 1)].mean() >= 0.9, kind
        assert y[own & passed].mean() >= 0.96, kind


def test_obfuscated_addresses(trained):
    for text, span in (("write to anna [at] example [dot] org today", (9, 36)), ("mail bob (at) site (dot) com now", (5, 28)), ("write to john at example.com now", (9, 28))):
        assert pii.find(text, *trained) == ([], [("email", *span)])
    for text in ("we met at noon.Then left", "look at house dot tree", "on 2024-01-02 at 10:11:12:13"):
        assert pii.find(text, *trained)[1] == []


def test_planted_data_in_the_tables_texts(spark, small, trained):
    rng = random.Random(5)
    forms = (lambda: ("email", f"{rng.choice(WORDS)[:1]}zoe at mailhost{rng.randrange(9)}.{rng.choice(['com', 'org', 'de'])}"), lambda: ("email", f"zoe{rng.randrange(99)} [at] mailhost [dot] net"), lambda: ("ip", "(.)".join(str(rng.randrange(1, 255)) for _ in range(4))), lambda: ("phone", f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"))
    hits = wrong = n = 0
    for r in read(spark, small, "documents").collect():
        words = (r.text or "").split(" ")
        at = rng.randrange(len(words))
        kind, data = rng.choice(forms)()
        head = "".join(w + " " for w in words[:at])
        base, every = pii.find(head + data + " " + " ".join(words[at:]), *trained)
        added = [s for s in every if s not in base]
        hits += (kind, len(head), len(head) + len(data)) in added
        wrong += sum(s != (kind, len(head), len(head) + len(data)) for s in added)
        n += 1
    assert hits >= 0.9 * n and wrong <= 0.02 * n


# ---- 4 segmentations


def vocabulary(alpha=0.25):
    with open(sentencepiece.MODEL, "rb") as f:
        return sentencepiece.Vocabulary(f.read(), alpha)


def all_segmentations(v, text):
    marked = "▁" + text.replace(" ", "▁")
    logp = {v.sp.id_to_piece(int(i)): (int(i), float(p)) for i, p in zip(v.ids, v.logp, strict=True)}
    out = []

    def go(i, ids, lp):
        if i == len(marked):
            out.append((tuple(ids), lp))
        for j in range(i + 1, len(marked) + 1):
            p = marked[i:j]
            if p in logp:
                go(j, [*ids, logp[p][0]], lp + logp[p][1])
            elif j == i + 1:
                go(j, [*ids, *(v.byte0 + b for b in p.encode())], lp + len(p.encode()) * v.byte_logp)

    go(0, [], 0.0)
    total = np.logaddexp.reduce([p for _, p in out])
    return {ids: p - total for ids, p in out}


def test_samples_are_distinct_and_follow_the_lattice():
    v, text, n = vocabulary(), "the on", 4000
    every = all_segmentations(v, text)
    got = sentencepiece.sample(v, [text] * n, [sentencepiece.row_key(i) for i in range(n)], k=3)
    assert all(len({tuple(s[0].tolist()) for s in found}) == 3 for found in got)
    assert all(abs(every[tuple(s[0].tolist())] - s[1]) < 1e-3 for found in got for s in found)
    assert all(a[2] >= b[2] for found in got for a, b in zip(found, found[1:], strict=False))
    first = Counter(tuple(f[0][0].tolist()) for f in got)
    second = Counter(tuple(f[1][0].tolist()) for f in got)
    p = {k: np.exp(x) for k, x in every.items()}
    for ids in sorted(p, key=p.get)[-3:]:
        assert abs(first[ids] / n - p[ids]) < 0.03
        without = sum(p[a] * p[ids] / (1 - p[a]) for a in p if a != ids)
        assert abs(second[ids] / n - without) < 0.03
    assert abs(np.mean([sum(np.exp(s[1]) / s[3] for s in f) for f in got]) - 1) < 0.02  # inclusion scores are unbiased weights


def test_segmentations_decode_to_the_text_and_small_sets_are_exhausted():
    v = vocabulary()
    texts = ["ab", None, "", "a  b\n\tçé 梦🙂 x ", "y" * 3000]
    got = sentencepiece.sample(v, texts, [1, 2, 3, 4, 5], k=5)
    for t, found in zip(texts, got, strict=True):
        assert all(v.sp.decode(s[0].tolist()) == (t or "") for s in found)
    assert len(got[0]) == len(all_segmentations(v, "ab")) and all(s[3] == 1.0 for s in got[0])
    assert [len(found) for found in got[1:3]] == [1, 1]
    again = sentencepiece.sample(v, texts[::-1], [5, 4, 3, 2, 1], k=5)[::-1]
    assert all(np.array_equal(a[0], b[0]) for x, y in zip(got, again, strict=True) for a, b in zip(x, y, strict=True))


def test_encode_decode_round_trip(make):
    df = make(odd_rows(random.Random(5)))
    back = sentencepiece.decode(sentencepiece.encode(df))
    want = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=repr)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == want
    sampled = sentencepiece.sample_segmentations(df, k=2)
    assert sorted({tuple(r) for r in sentencepiece.decode(sampled).collect()}, key=repr) == sorted(set(want), key=repr)
    assert sentencepiece.sample_segmentations(df.limit(0)).count() == 0


# ---- 5 toxicity


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = [r for r in got if r.toxic == 1]
    clean = [r for r in got if r.toxic == 0]
    assert np.mean([r.predicted for r in hit]) > 0.85
    assert np.mean([r.predicted for r in clean]) < 0.02
    assert np.mean([a.score > b.score for a in hit for b in clean]) > 0.97


def test_classifier_edge_cases(spark, make):
    rng = random.Random(6)
    rows = [(i, prose(rng, 40) + (" vile" if i % 3 == 0 else "")) for i in range(240)] + [(900, None), (901, ""), (None, "no id"), (902, "vile " * 20_000), (902, "vile " * 20_000)]
    df = make(rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(df, labels).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got}
    assert min(score[i] for i in range(0, 240, 3)) > max(score[i] for i in range(240) if i % 3) and score[900] == score[901] < 0.3 < score[902]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and 902 not in {r.doc_id for r in kept.collect()}
    assert {r.score for r in toxicity.classify(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(df.limit(0), labels).count() == 0


# ---- 7 SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (doc, fp); smallest doc reachable over links of at most two bits."""
    near = np.bitwise_count(np.array([f for _, f in fps], np.uint64)[:, None] ^ np.array([f for _, f in fps], np.uint64)[None, :]) <= 2
    label = np.array([d for d, _ in fps])
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label
        label = new


def test_simhash_matches_brute_force(make):
    rng = random.Random(7)
    rows = [r for r in odd_rows(rng) if r[0] is not None] + [(100 + i, "ÄB c " + prose(rng, 60)) for i in range(30)]
    got = simhash.near_duplicates(make(rows)).collect()
    want = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((d, f"{f:016x}") for d, f in want)
    label = {d: c for (d, _), c in zip(want, brute_components(want), strict=True)}
    assert all(r.component_id == label[r.doc_id] for r in got)
    assert simhash.near_duplicates(make(rows).limit(0)).count() == 0


def test_gray_index_finds_every_link(spark):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2**63, 700, dtype=np.uint64)
    near = np.concatenate([seeds] + [seeds[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(3)])
    fps = np.unique(near)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.hamming_links(df, leaf=16, fan=4)
    root = {r.node: r.root for r in connected_components(links).collect()}
    label = brute_components(list(zip(range(len(fps)), fps.tolist(), strict=True)))
    ours = [root.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(ours, label.tolist(), strict=True))) == len(set(ours)) == len(set(label.tolist()))


def test_rows_without_id(make):
    got = simhash.near_duplicates(make([(None, "same text here now"), (5, "same text here now"), (None, "quite another one")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(5, 5)]
    assert {r.component_id for r in got if r.doc_id is None} == {5, None}


# ---- 9 line chunks


def earlier_lines(rows):
    """Per row the numbers of the lines that go, by looking every pair of neighbouring lines up among those seen before; written without the operator's helpers."""
    seen, gone = set(), {}
    for d, t in sorted({r[:2] for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0, xxh(r))):
        lines_ = t.split("\n")
        units, i = [], 0
        for i, x in enumerate(lines_):
            if x.strip():
                if len(x.split()) >= 50:
                    units.append((i, i))
                back = i
                while back and not lines_[back - 1].strip():
                    back -= 1
                if back < i - 1:
                    units.append((back, i))
            if i and (x.strip() or lines_[i - 1].strip()):
                units.append((i - 1, i))
        gone[d, t] = set()
        for a, b in sorted(units, key=lambda u: (u[0], u[1])):
            key = tuple(lines_[a : b + 1])
            if key in seen:
                gone[d, t] |= set(range(a, b + 1))
            seen.add(key)
    return gone


def xxh(row):
    """Rows of one id are taken in the order of their hash in Spark; the tests' tables have no such rows that share lines."""
    return row[1]


@pytest.mark.parametrize("seed", [9, 19])
def test_line_dedup_matches_brute_force(make, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice([1, 3, 9, 60]), 0).strip() for _ in range(40)] + ["", "", " "]
    long_ = [prose(rng, 9, 0).strip() for _ in range(40)]
    rows = [r for r in odd_rows(rng) if r[0] is not None]
    for i in range(60):
        body = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        if i % 4 == 0:
            at = rng.randrange(20)
            body[rng.randrange(len(body)) : 0] = long_[at : at + rng.randrange(2, 20)]
        rows.append((200 + i, "\n".join(body)))
    rows += [rows[-1], (None, "\n".join(pool[:3]))]
    want = earlier_lines(rows)
    got = {(r.doc_id, r.of): r for r in lines.dedup_lines(make(rows).withColumn("of", F.col("text"))).collect()}
    for (d, t), gone in want.items():
        assert got[d, t].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone), (d, t)
        assert got[d, t].n_removed_ == len(gone)
    assert {r.text for (d, t), r in got.items() if t is None} == {None}
    out = lines.clean(make(rows))
    assert out.columns == make(rows).columns and all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None and (r.doc_id or 0) >= 200)
    assert lines.dedup_lines(make(rows).limit(0)).count() == 0


def test_chunks_find_most_of_long_passages(make, monkeypatch):
    rng = random.Random(29)
    passage = "\n".join(prose(rng, 9, 0).strip() for _ in range(40))
    rows = [(i, f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20)}") for i in range(8)]
    keys = lines._keys(make(rows))
    whole = lines._later(keys.where("inside = -1"))
    assert whole.groupBy("doc").agg(F.sum("n_lines").alias("n")).where("n > 20").count() == 7
    monkeypatch.setattr(lines, "pairs", lambda x: [])  # chunks alone
    assert sum(r.n_removed_ for r in lines.dedup_lines(make(rows)).collect()) >= 7 * 20


def test_chunk_bounds_follow_content():
    rng = random.Random(10)
    body = [prose(rng, 5, 0) for _ in range(300)]
    a, b = lines.chunk_starts(body), lines.chunk_starts(["shift", *body])
    assert len({x + 1 for x in a} & set(b)) > 0.9 * len(a)


def test_shared_passages_go_whole(make):
    rng = random.Random(14)
    line = lambda n: prose(rng, n, 0).strip()
    passages = [[line(60)], [line(30), line(30)], [line(20), "", "", "", line(35)], [line(13) for _ in range(5)], [line(9) for _ in range(40)]]
    rows = [(1, "\n".join(passages[0])), (2, line(9))]
    for k, p in enumerate(passages):
        rows += [(10 * k + i, "\n".join([line(8), line(7), *p, line(6)])) for i in range(10, 14)] + [(10 * k + 14, "\n".join([*p, line(6)])), (10 * k + 15, "\n".join([line(6), *p, line(5), *p]))]
    rows += [(90, rows[3][1].split("\n")[0] + "\n" + line(9)), (91, "a\nb\nb\nb\nb")]
    got = {r.doc_id: r for r in lines.dedup_lines(make(rows), lines.repeated_chunks(make(rows))).collect()}
    for k, p in enumerate(passages):
        for i in range(10, 16):
            r, text = got[10 * k + i], dict(rows)[10 * k + i]
            first = i == 10 and k > 0
            assert r.text == (text if first else text.replace("\n".join(p), "\0").replace("\n\0", "").replace("\0\n", "")), (k, i)
    assert got[1].text == rows[0][1] and got[90].text == rows[-2][1] and got[91].text == "a\nb"  # lines two and on repeat the pair before them


# ---- 10 repeated byte strings


def brute_removed(rows, length):
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = Counter()
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[(d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())] += 1
    return out


def test_repeats_match_brute_force(make):
    rng = random.Random(11)
    passage = prose(rng, 150)
    rows = [(r[0], r[1][:9000] if r[1] else r[1]) for r in odd_rows(rng)]
    rows += [(300 + i, prose(rng, 30) + passage[i * 7 :] + prose(rng, 30)) for i in range(6)] + [(400, "ab" * 700), (401, "z" * 2000), (402, prose(rng, 50) + passage + prose(rng, 9) + passage)]
    got = Counter(tuple(r) for r in repeats.summary(make(rows)).collect())
    assert got == brute_removed(rows, 400)
    assert repeats.summary(make(rows).limit(0)).count() == 0


def test_repeats_across_segments(make, monkeypatch):
    rng = random.Random(12)
    a = prose(rng, 900)
    rows = [(1, a), (2, "head " + a[100:]), (3, a[500:2600])]
    monkeypatch.setattr(repeats, "_SEGMENT", 700)
    found = [x for _, t in rows for x in repeats.runs(t.encode(), 400)]
    assert all(n <= 700 for _, n, *_ in found)
    assert Counter(tuple(r) for r in repeats.summary(make(rows)).collect()) == brute_removed(rows, 400)


def test_multikey_quicksort():
    rng = np.random.default_rng(13)
    keys = [rng.integers(-3, 3, 30_000), rng.integers(-(2**62), 2**62, 30_000), rng.integers(0, 2, 30_000)]
    keys[1][:20_000] = 5
    order = repeats.multikey_quicksort(keys)
    assert sorted(order.tolist()) == list(range(30_000))
    rows = np.stack([k[order] for k in keys], axis=1)
    want = np.stack([k[np.lexsort(keys[::-1])] for k in keys], axis=1)
    assert np.array_equal(rows, want)
    assert len(repeats.multikey_quicksort([np.zeros(0, np.int64)])) == 0


def test_inclusion_is_exact_where_the_lattice_is_small():
    """All segmentations of short texts, enumerated: the draws' log-probabilities, and inclusion over many draws."""
    for alpha, text in ((0.25, "ab"), (1.0, "ab"), (6.0, "on")):  # the last has segmentations of mass far below 1e-7
        v = vocabulary(alpha)
        every = all_segmentations(v, text)
        for found in sentencepiece.sample(v, [text] * 3, [1, 2, 3], k=len(every) + 2):
            assert {tuple(f[0].tolist()) for f in found} == set(every) and all(f[3] == 1.0 for f in found)
            assert all(abs(every[tuple(f[0].tolist())] - f[1]) < 1e-4 for f in found)
    v, n, k = vocabulary(0.25), 3000, 2
    every = all_segmentations(v, "the")
    got = sentencepiece.sample(v, ["the"] * n, [sentencepiece.row_key(i) for i in range(n)], k=k)
    weight = Counter()
    for found in got:
        for ids, logp, _, score in found:
            weight[tuple(ids.tolist())] += 1 / score  # the inverse inclusion score makes every segmentation count once
            assert 0 < score <= 1 and logp <= 0
    total = sum(np.exp(every[s]) * w / n for s, w in weight.items())
    assert abs(total - 1) < 0.1
    forgetful = sentencepiece.Lattices(v, room=40)
    v.lattices = forgetful
    words = ["the cat", "on the mat", "a dog ran far away", "the cat", ""]
    small = [[f[0].tolist() for f in sentencepiece.sample(v, [w], [i], k=2)[0]] for i, w in enumerate(words)]
    v.lattices = sentencepiece.Lattices(v)
    assert small == [[f[0].tolist() for f in found] for found in sentencepiece.sample(v, words, list(range(5)), k=2)]
    shared = sentencepiece.Lattices(v)  # words with one ending share its rows, whose edges are those of a word alone
    names = ["▁the", "▁bathe", "▁clothe", "the", "e", "▁cat", "▁xat"]
    shared.look_up([names])
    assert shared.rows < sum(map(len, names)) == len(shared.row_at)
    for name in names:
        alone = sentencepiece.Lattices(v)
        alone.look_up([[name]])
        at = shared.start[shared.names[name]]
        for d in range(len(name)):
            one, other = shared.edges(int(shared.row_at[at + d])), alone.edges(int(alone.row_at[d]))
            assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(one, other, strict=True))


def plain_ftrl(rows, labels, epochs, alpha, beta, l1, l2, least_rows):
    """FTRL-proximal one row and one coordinate at a time."""
    seen = Counter(f for r in rows for f in r)
    sets = [[0, *(int(f) for f in r if seen[f] >= least_rows)] for r in rows]
    z, n, rng = Counter(), Counter(), np.random.default_rng(7)

    def weight(f):
        bound = 0.0 if f == 0 else l1
        return 0.0 if abs(z[f]) <= bound else (np.sign(z[f]) * bound - z[f]) / ((beta + n[f] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for r in rng.permutation(len(sets)):
            w = {f: weight(f) for f in sets[r]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[r]
            for f in sets[r]:
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z if weight(f) or f == 0}


def test_ftrl_equals_a_plain_one():
    rng = random.Random(19)
    rows = [np.unique(np.array([rng.randrange(1, 40) for _ in range(12)], np.uint32)) for _ in range(60)]
    labels = np.array([float(3 in r or 7 in r) for r in rows])
    options = {"epochs": 3, "alpha": 2.0, "beta": 1.0, "l1": 0.5, "l2": 0.05, "least_rows": 5}
    names, weights = toxicity.ftrl(rows, labels, **options)
    want = plain_ftrl(rows, labels, **options)
    assert dict(zip(names.tolist(), weights.tolist(), strict=True)) == pytest.approx(want)
    assert len(want) < 40  # L1 leaves some at zero


def test_labels_of_one_kind_and_bounded_weights(spark, make):
    docs = make([(i, f"some words {i}") for i in range(20)])
    for kind in (0, 1):
        labels = spark.createDataFrame([(i, kind) for i in range(20)], "doc_id long, toxic int")
        scores = {r.score for r in toxicity.classify(docs, labels).collect()}
        assert len(scores) == 1 and (scores.pop() > 0.5) == bool(kind)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.0} and toxicity.keep_clean(docs, none).count() == 20
    rows = [(i, " ".join(f"{'bad' if i % 2 else 'good'}{j % 9} w{(i * j) % 30}" for j in range(30))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    wide, narrow = toxicity.train(make(rows), labels), toxicity.train(make(rows), labels, most_weights=12)
    assert len(wide) > 12 >= len(narrow) and toxicity.BIAS in narrow


def test_operators_leave_columns_of_any_name_alone(make):
    names = ("gone_doc", "gone_uid", "gone_spans", "n_lines_", "n_removed_", "size_", "same_", "whole_", "taken_", "id_", "hash_", "u1", "u2", "kept_u1", "kept_u2")
    docs = make([(1, "a line of text\nand one more of it\nthird"), (2, "other\na line of text\nand one more of it"), (3, None), (4, "")]).selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for out in (lines.clean(docs), mixing.mix_documents(docs), simhash.keep_one_similar(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert {r.doc_id: r.text for r in lines.clean(docs).collect()} == {1: "a line of text\nand one more of it\nthird", 2: "other", 3: None, 4: ""}


def test_pieces_spell_what_the_tokenizer_decodes():
    v = vocabulary()
    texts = ["the cat\nsat", "  two  spaces ", "日本 é 😀", "", "a▁b", "tab\tand 123.45"]
    for text, found in zip(texts, sentencepiece.sample(v, texts, list(range(6)), k=2), strict=True):
        for ids, *_ in found:
            assert v.sp.decode(ids.tolist()) == text.replace("▁", " ")
            assert v.spell(ids).decode() == ("▁" + text.replace(" ", "▁") if text else "")
