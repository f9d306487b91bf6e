"""Operator 5: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the set of a text's lower-cased words and their stems of four to six letters, word pairs and pairs with
one word between, hashed to 32 bits.
Training takes a bounded sample of labelled rows (at most ``train_rows``, picked by a hash of their id), split
into shards of at most ``shard_rows``; each shard runs FTRL-proximal with per-coordinate learning rates and L1, and
the shards' sparse weights are averaged. Features of fewer than ``least_rows`` rows of a shard are not learnt, as is usual for rare
words. Only coordinates that L1 leaves above zero remain. They are broadcast to the scoring tasks; should they be more than
``most_weights``, training is repeated with half as much L1 again until they are not, so no weight of a model is ever cut off.

Defined cases: a null or empty text has no features and scores by the bias alone; labels that are null, or whose doc_id is null,
are not used; several labels of one document count as one, toxic if any is; with labels of one kind only, every score is
that kind's smoothed share, (toxic + 1) / (n + 2), and without any it is 0; repeated documents score alike; very long texts are
scored whole; only ``doc_id`` and ``text`` are inputs of training and of scores, so other columns may have any name; an empty table
gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, hash_sample, store

_EDGE = re.compile(r"^\W+|\W+$")
_ROOM, _STEMS = 1 << 17, (4, 5, 6)
_IDS: dict[str, int] = {}
_HASHES = np.zeros((_ROOM, 1 + len(_STEMS)), np.uint64)  # of each known word and of its stems; 0 where there is no stem
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BIAS = 0  # feature 0 is kept for the bias


def _word_id(word: str) -> int:
    i = _IDS[word] = len(_IDS)
    bare = _EDGE.sub("", word) or word
    forms = [bare, *(f"{bare[:k]}*" if len(bare) > k else "" for k in _STEMS)]
    _HASHES[i] = [xxhash.xxh3_64_intdigest(f.encode("utf-8", "replace")) if f else 0 for f in forms]
    return i


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_IDS) + len(words) > _ROOM:
        _IDS.clear()
    if len(words) > _ROOM:
        return np.concatenate([_word_hashes(words[i : i + _ROOM]) for i in range(0, len(words), _ROOM)])
    get = _IDS.get
    ids = [i if (i := get(w)) is not None else _word_id(w) for w in words]
    return _HASHES[np.array(ids, np.int64)]


def features(text: str | None) -> np.ndarray:
    """Hashed n-grams and skip-grams of a text, repeats included, as uint32 above 0."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint32)
    forms = _word_hashes(words)
    h = forms[:, 0]
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * _PAIR) ^ h[1:]
        skips = (h[:-2] * _SKIP) ^ (h[2:] >> np.uint64(1))
        all_ = np.concatenate((forms[forms != 0], pairs * _SKIP, skips * _PAIR)) >> np.uint64(32)
    return np.maximum(all_.astype(np.uint32), 1)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 8, alpha: float = 2.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.05, least_rows: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over sets of features: (feature, weight) for the weights that are not zero, the bias among them.

    Features of fewer than ``least_rows`` rows are left out before training; the bias is not regularised by L1.
    """
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.uint32)
    order = np.sort(flat)
    new = np.concatenate(([True], order[1:] != order[:-1])) if len(order) else np.empty(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate((at, [len(order)])))
    kept = order[at[counts >= least_rows]] if len(order) else order
    names = np.concatenate((np.zeros(1, np.uint32), kept))
    idx = np.searchsorted(kept, flat).clip(max=max(len(kept) - 1, 0))
    ok = kept[idx] == flat if len(kept) else np.zeros(len(flat), bool)
    ends = np.cumsum(sizes)
    sets = [np.concatenate(([0], idx[e - n : e][ok[e - n : e]] + 1)) for e, n in zip(ends, sizes, strict=True)]
    z, n = np.zeros(len(names)), np.zeros(len(names))
    one = np.full(len(names), l1)
    one[0] = 0.0
    rng = np.random.default_rng(7)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= one[i], 0.0, (np.sign(zi) * one[i] - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for r in rng.permutation(len(sets)):
            i = sets[r]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[r]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(len(names)))
    keep = np.flatnonzero((w != 0) | (np.arange(len(names)) == 0))
    return names[keep], w[keep]


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, shard_rows: int = 4000, most_weights: int = 20_000, l1: float = 3.0, **options) -> dict[int, float]:
    """Sparse weights by feature. ``train_rows`` bounds the labelled rows that are fitted."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = store(known.where(~held_out(F.col("doc_id"))), "known")
    chosen = store(hash_sample(known, "doc_id", train_rows, "fit"), "labels")
    n, toxic = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic in (0, n):
        return {BIAS: float(np.log((toxic + 1) / (n - toxic + 1)))} if n else {}
    shards = -(-n // shard_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most train_rows rows are broadcast

    def extract(batch):
        return {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "features": [np.unique(features(t)).tobytes() for t in batch["text"]]}

    sets = arrow_map(rows, "doc_id long, toxic int, features binary", extract)
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards))
    sets = store(sets.withColumn("shard", shard), "fitted")  # at most train_rows rows

    def fitted(l1: float) -> DataFrame:
        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.drop_duplicates("doc_id").sort_values("doc_id")
            f, w = ftrl([np.frombuffer(x, np.uint32) for x in pdf.features], pdf.toxic.to_numpy(np.float64), l1=l1, **options)
            return pd.DataFrame({"feature": f.astype(np.int64), "weight": w})

        each = sets.groupBy("shard").applyInPandas(fit, "feature long, weight double")
        return each.groupBy("feature").agg((F.sum("weight") / shards).alias("weight"))

    while True:
        found = fitted(l1).orderBy("feature").limit(most_weights + 1).collect()
        if len(found) <= most_weights:
            return {r.feature: r.weight for r in found}
        l1 *= 1.5


def _scorer(spark: SparkSession, weights: dict[int, float]):
    """A function from texts to scores; the weights go to the tasks as a broadcast of two short arrays."""
    names = np.array(sorted(k for k in weights if k != BIAS), np.uint32)
    model = spark.sparkContext.broadcast((names, np.array([weights[int(k)] for k in names], np.float64), weights.get(BIAS)))

    def run(texts: list[str | None]) -> list[float]:
        names, values, bias = model.value
        if bias is None:
            return [0.0] * len(texts)
        low = np.uint32((1 << 20) - 1)
        some = np.zeros(1 << 20, bool)
        some[names & low] = True
        out = []
        for text in texts:
            f = features(text)
            f = np.unique(f[some[f & low]])
            total = bias
            if len(f):
                at = np.searchsorted(names, f).clip(max=len(names) - 1)
                total += values[at[names[at] == f]].sum()
            out.append(float(1 / (1 + np.exp(-np.clip(total, -700, 700)))))
        return out

    return run


def score(docs: DataFrame, weights: dict[int, float], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on) for every row of ``docs``."""
    scorer = _scorer(docs.sparkSession, weights)
    run = lambda batch: {"doc_id": batch["doc_id"], "score": scorer(batch["text"])}
    scored = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double", run)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options), threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, filtered as they are scored."""
    scorer = _scorer(docs.sparkSession, train(docs, labels, **options))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array([s < threshold for s in scorer(part.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
