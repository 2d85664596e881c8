"""Tables and document collections as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from lakeline.config import DocTarget, Target


def read_target(spark: SparkSession, target: Target) -> DataFrame:
    """Read any store by its configured format."""
    reader = spark.read.format(target.format).options(**target.options)
    if target.schema is not None:
        reader = reader.schema(target.schema)
    return reader.load()


def read_whole(spark: SparkSession, target: Target) -> DataFrame:
    """A whole store, to be copied.

    A database table is read by ``numPartitions`` tasks over the range of its
    ``partitionColumn``, which the database is asked for unless the options name the
    bounds. A table without one would go through a single connection, and is refused
    unless the options ask for ``numPartitions`` 1.
    """
    if target.format != "jdbc":
        return read_target(spark, target)
    options = split_options(target.options)
    if "partitionColumn" in options and "lowerBound" not in options:
        return read_jdbc(
            spark,
            options.pop("url"),
            options.pop("dbtable"),
            options.pop("partitionColumn"),
            n=int(options.pop("numPartitions")),
            **options,
        )
    return read_target(spark, replace(target, options=options))


def split_options(options: Mapping[str, str]) -> dict[str, str]:
    """The options of a table read in parts; an error if they would read it in one part unasked."""
    parts = options.get("numPartitions")
    if options.get("partitionColumn") and parts:
        return dict(options)
    if parts == "1":
        return {k: v for k, v in options.items() if k != "numPartitions"}
    raise ValueError(
        "a table is copied by many tasks: give partitionColumn and numPartitions, "
        "or numPartitions 1 to read it by one"
    )


def read_docs(spark: SparkSession, target: DocTarget) -> DataFrame:
    """A document collection. Give the target a schema: collections have none of their own."""
    return read_target(spark, target)


def jdbc_options(
    url: str,
    table: str,
    partition_col: str | None = None,
    lo: object = None,
    hi: object = None,
    n: int | None = None,
    **extra: str,
) -> dict[str, str]:
    """Reader options; with a partition column the table is read by ``n`` tasks.

    ``lo`` and ``hi`` only shape the ranges: rows outside fall in the first or last.
    """
    options = {"url": url, "dbtable": table, **extra}
    split = (partition_col, lo, hi, n)
    if all(part is None for part in split):
        return options
    if any(part is None for part in split):
        raise ValueError("a split read needs partition_col, lo, hi and n together")
    return {
        **options,
        "partitionColumn": partition_col,
        "lowerBound": str(lo),
        "upperBound": str(hi),
        "numPartitions": str(n),
    }


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_col: str | None = None,
    lo: object = None,
    hi: object = None,
    n: int | None = None,
    **extra: str,
) -> DataFrame:
    """A relational table. Connection properties such as ``user`` come from the caller.

    With a partition column and ``n`` but no bounds, the database is asked for
    the column's range first.
    """
    if partition_col is not None and n is not None and lo is None and hi is None:
        bounds = f"(select min({partition_col}) lo, max({partition_col}) hi from {table}) bounds"
        lo, hi = spark.read.format("jdbc").options(**jdbc_options(url, bounds, **extra)).load().head()
        if lo is None:
            partition_col = n = None  # an empty table has no range to split
    options = jdbc_options(url, table, partition_col, lo, hi, n, **extra)
    return spark.read.format("jdbc").options(**options).load()
