"""Operator 1: mix sources to target weights.

Every document gets a hash-random key. Within each source the documents are range-sorted by that key, distributed
prefix sums of their word counts place each on the source's word line, and the line is cut at the source's exact
budget; a budget above the source's size repeats whole epochs first.

Defined cases: a null text or one without words has size 0 and takes nothing; a null source is a source of its
own, last in order; a null ``doc_id`` hashes as the empty string; rows with equal ids are told apart by their size and are
otherwise interchangeable; an empty table gives an empty plan. Only ``doc_id``, ``source`` and ``text`` are read, so other columns may
have any name; texts of any length are counted whole, and only ids and sizes are shuffled for the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, running_totals, store, word_count


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: str = "") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, weight, target, taken.

    Sources in code point order (null last) get ``weights`` in turn and share all words; a target stops at
    ``most_epochs`` times its source's size and the excess is shared again by weight.
    """
    sized = store(
        docs.select(
            "doc_id",
            "source",
            F.when(F.col("source").isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("line_"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key_"),
        ),
        "sized",
    )
    sources = sized.groupBy("line_").agg(F.sum("size").alias("source_size")).withColumn("one_", F.lit(1).cast("long"))
    ranked = running_totals(sources, [], ["line_"], "one_", "rank_", "sources")
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank_") % len(weights) + 1).cast("int"))
    sources = store(ranked.select("line_", "source_size", turn.alias("weight")), "sources")
    level = _level(sources, most_epochs)
    cap = F.col("source_size").cast("double") * most_epochs
    target = F.least(F.col("weight") * F.lit(level), cap)
    sources = sources.select("line_", "source_size", "weight", target.alias("target"), F.round(target).cast("long").alias("budget_"))
    placed = running_totals(sized, ["line_"], ["key_", "doc_id", "size"], "size", "before_", "placed")
    size, whole = F.col("size"), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(F.col("budget_") / F.greatest(whole, F.lit(1)))).otherwise(0)
    cut = F.greatest(F.lit(0), F.least(size, F.col("budget_") - epochs * whole - F.col("before_")))
    return placed.join(sources, "line_").select("doc_id", "source", "size", "source_size", "weight", "target", (epochs * size + cut).cast("long").alias("taken"))


def _level(sources: DataFrame, most_epochs: int) -> float:
    """Words per unit of weight once the excess of full sources is shared: a few aggregates over the sources' table."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while total:
        over = F.col("weight") * F.lit(level) > F.col("source_size").cast("double") * most_epochs
        if full < 0:
            over = F.lit(False)
        row = sources.agg(
            F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("source_size") * most_epochs)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if row.n == full or not row.open:
            break
        full, level = row.n, float(total - row.held) / float(row.open)
    return level


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: ``docs`` rows once per whole pass, and the document at each source's cut as its first words.

    Rows that agree in doc_id, source and text share what they take evenly.
    """
    size_, same_, whole_, taken_, id_, hash_ = fresh(docs, "size_", "same_", "whole_", "taken_", "id_", "hash_")
    key = lambda size: F.xxhash64(F.col("doc_id"), F.col("source"), F.col(size))
    plan = mix_plan(docs, **options).where("taken > 0").select(F.col("doc_id").alias(id_), key("size").alias(hash_), "taken")
    share = store(plan.groupBy(id_, hash_).agg((F.sum("taken") / F.count(F.lit(1))).cast("long").alias(taken_)), "share")
    rows = docs.withColumn(size_, word_count(F.col("text")))
    rows = rows.withColumn(same_, key(size_))
    rows = rows.join(share.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(same_) == F.col(hash_)))
    part = F.col(taken_) % F.col(size_)
    first = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), part.cast("int")))
    copies = F.concat(F.array_repeat(F.lit(True), F.floor(F.col(taken_) / F.col(size_)).cast("int")), F.when(part > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    rows = rows.withColumn(whole_, F.explode(copies)).withColumn("text", F.when(F.col(whole_), F.col("text")).otherwise(first))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(whole_), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
