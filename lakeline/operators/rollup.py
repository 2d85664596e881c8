"""One pass over the readings, from which every sensor metric can be derived.

Reading text files is the dear part of refreshing metrics. The rollup holds one
row per sensor and time bucket with sums, counts and the last reading; all of
them can be merged further, so no derived table needs the readings again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.functions.readings import (
    CLASSES,
    ReadingRanges,
    last_of,
    reading_class,
    valid_or_null,
)


def rollup(
    readings: DataFrame,
    keys: Sequence[str],
    width: str = "1 hour",
    measurement: str = "measurement",
    timestamp: str = "timestamp",
    ranges: ReadingRanges = ReadingRanges(),
    repeatable: bool = False,
) -> DataFrame:
    """Mergeable totals per sensor and time bucket; readings without a time share a NULL bucket.

    Of several readings at the last instant of a bucket any may be its last;
    ``repeatable`` takes the largest, at the price of a sort.
    """
    value = F.col(measurement)
    if repeatable:
        last = [last_of(value, F.col(timestamp)).alias("_last")]
    else:
        last = [
            F.max(timestamp).alias("last_seen"),
            F.max_by(value, timestamp).alias("last_measurement"),
        ]
    kind = reading_class(value, ranges)
    # A window leaves out rows without a time, so they are grouped under a stand-in.
    stand_in = F.lit(0).cast("timestamp").cast(readings.schema[timestamp].dataType)
    timed = F.col(timestamp).isNotNull().alias("_timed")
    bucket = F.window(F.coalesce(F.col(timestamp), stand_in), width).alias("_bucket")
    grouped = readings.groupBy(*keys, timed, bucket).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(kind == name).alias(f"n_{name}") for name in CLASSES],
        F.count(value).alias("n_measured"),
        F.sum(value).alias("sum_measured"),
        F.sum(valid_or_null(value)).alias("sum_valid"),
        *last,
    )
    if repeatable:
        grouped = grouped.select(
            "*",
            F.col("_last.timestamp").alias("last_seen"),
            F.col("_last.measurement").alias("last_measurement"),
        ).drop("_last")
    totals = [c for c in grouped.columns if c not in (*keys, "_timed", "_bucket")]
    start = F.when(F.col("_timed"), F.col("_bucket.start"))
    return grouped.select(*keys, start.alias("bucket"), *totals)


def merge_rollups(totals: DataFrame, keys: Sequence[str], *further: Column) -> DataFrame:
    """One row per sensor and bucket from rollups of parts of the readings.

    ``further`` aggregates merge columns that a caller added.
    """
    sums = [c for c in totals.columns if c.startswith(("n", "sum_")) and c not in keys]
    merged = totals.groupBy(*keys, "bucket").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max("last_seen").alias("last_seen"),
        F.max_by("last_measurement", "last_seen").alias("last_measurement"),
        *further,
    )
    return merged.select(totals.columns)


def total_metrics(totals: DataFrame) -> DataFrame:
    """The single row ``sensor_metrics`` gives over the readings."""
    n_invalid = F.coalesce(F.sum("n_invalid"), F.lit(0))
    return totals.agg(
        F.try_divide(F.sum("sum_measured"), F.sum("n_measured")).alias("average_measurement"),
        n_invalid.alias("count_invalid_measurements"),
        F.try_divide(F.sum("sum_valid"), F.sum(_n_valid())).alias("average_valid"),
    )


def total_health(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The counts ``health_counts`` gives over the readings."""
    return totals.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.sum(f"n_{name}").alias(f"n_{name}") for name in CLASSES],
        F.try_divide(F.sum("sum_valid"), F.sum(_n_valid())).alias("average_valid"),
        F.max("last_seen").alias("last_seen"),
    )


def total_means(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bucket means ``bucket_means`` gives over the readings; nothing is regrouped."""
    return totals.where(F.col("bucket").isNotNull()).select(
        *keys,
        "bucket",
        "n",
        _n_valid().alias("n_valid"),
        F.try_divide("sum_measured", "n_measured").alias("average_measurement"),
        F.try_divide(F.col("sum_valid"), _n_valid()).alias("average_valid"),
    )


def total_last(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last readings ``last_readings`` gives over the readings."""
    return totals.groupBy(*keys).agg(
        F.max("last_seen").alias("last_seen"),
        F.max_by("last_measurement", "last_seen").alias("last_measurement"),
    )


def _n_valid():
    return F.col("n") - F.col("n_invalid")
