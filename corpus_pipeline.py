"""A corpus cleaned and packed for training, stage by stage; every stage is one operator of ``riverglass.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riverglass.llm import lines, mixing, sentencepiece, simhash, toxicity
from riverglass.llm.common import read, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels table; documents that the classifier rejects go."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.clean(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose sets of five-word shingles reach a Jaccard similarity of 0.8 are copies; one of each group stays."""
    return simhash.keep_one_similar(docs, words=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, rank, ids, n_pieces, log_prob, inclusion): two sampled segmentations of each document of the mix."""
    return sentencepiece.sample_segmentations(docs, k=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("mixing", mix_sources),
    ("sentencepiece", encode_documents),
]

# A learned filter and sampled segmentations are not expressible in SQL. tests/llm compares the copies' stage with all pairs; of the other
# stages it tests the operators against plain versions, and here that each hands on the right rows and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
