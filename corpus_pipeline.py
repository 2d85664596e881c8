"""From raw documents to packed training sequences, in stages that each read what the last kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeline.llm.common import Staging, read_table
from lakeline.llm.copies import drop_copies
from lakeline.llm.near_copies import Likeness, drop_near_copies
from lakeline.llm.packing import pack
from lakeline.llm.personal_data import mask
from lakeline.llm.toxicity import drop_toxic, learn

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels, scores below one half."""
    return drop_toxic(docs, learn(docs, read_table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest id stays."""
    return drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8 the first stays."""
    return drop_near_copies(docs, Likeness(words=5, percent=80))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("near dedup", near_duplicates),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL cannot express the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all documents; each stage is staged as Parquet."""
    staging = Staging(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, staging.keep(stage(spark, docs, sf_dir))
        staging.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
