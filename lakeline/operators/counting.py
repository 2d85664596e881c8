"""Counts per key, thresholds on counts, and global top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    """Rows per key. Counts are partial before the shuffle, so a hot key costs one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def having_over(counts: DataFrame, threshold: int, name: str = "n") -> DataFrame:
    """Keep groups strictly above the threshold."""
    return counts.where(F.col(name) > threshold)


def by_count(counts: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Largest count first; ties in key order, so the result is repeatable."""
    return counts.orderBy(F.desc(name), *keys)


def top_k(df: DataFrame, k: int, measure: str, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest measure: each task keeps ``k`` rows, nothing is fully sorted.

    NaN and NULL are no measure. They rank last and are dropped from the ``k``
    rows found, which spares a second evaluation of the measure in a filter.
    """
    if dict(df.dtypes)[measure] in ("float", "double"):
        df = df.withColumn(measure, F.nanvl(measure, F.lit(None)))
    ranked = df.orderBy(F.desc_nulls_last(measure), *ties).limit(k)
    return ranked.where(F.col(measure).isNotNull())
