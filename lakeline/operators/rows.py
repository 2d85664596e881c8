"""Row-level operators: distinct rows, dropping a row by position, reject splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole rows once each; copies collapse inside every task before the shuffle."""
    return df.distinct()


def drop_second_row(df: DataFrame, order_by: str) -> DataFrame:
    """Drop the row at position 1 in the order of a unique key.

    The victim is a top-2 over the key column alone, used as a scalar subquery:
    no sort of the table, no join, no window.
    """
    second = df.select(order_by).orderBy(order_by).offset(1).limit(1).scalar()
    # The subquery is NULL when there is no second row: then everything stays.
    return df.where(F.coalesce(F.col(order_by) != second, F.lit(True)))


def split_rejects(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """``(rows where good holds, all the others)``; a NULL verdict is a reject."""
    verdict = F.coalesce(good, F.lit(False))
    return df.where(verdict), df.where(~verdict)
