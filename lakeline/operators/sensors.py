"""Sensor metrics: quality, health, bucket means and who is online.

The aggregating functions work unchanged on a stream. Every aggregate is partial
before the shuffle, so a sensor that sends a third of all readings leaves each
task as one row; all but the repeatable last reading aggregate by hash.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.functions.readings import (
    CLASSES,
    ReadingRanges,
    is_invalid,
    last_of,
    reading_class,
    valid_or_null,
)
from lakeline.operators.counting import count_by

HOUR = datetime.timedelta(hours=1)


def sensor_metrics(readings: DataFrame, measurement: str = "measurement") -> DataFrame:
    """One row: mean of all readings, number of invalid ones, mean of the valid ones.

    ``average_measurement`` skips NULL but takes the burnt-out mark as a value;
    ``average_valid`` leaves both out.
    """
    return readings.agg(*metric_columns(measurement))


def metric_columns(measurement: str = "measurement") -> list[Column]:
    """The aggregates of ``sensor_metrics``."""
    value = F.col(measurement)
    return [
        F.avg(value).alias("average_measurement"),
        F.count_if(is_invalid(value)).alias("count_invalid_measurements"),
        F.avg(valid_or_null(value)).alias("average_valid"),
    ]


def class_counts(
    readings: DataFrame,
    measurement: str = "measurement",
    ranges: ReadingRanges = ReadingRanges(),
) -> DataFrame:
    return count_by(readings, reading_class(F.col(measurement), ranges).alias("class"))


def health_counts(
    readings: DataFrame,
    keys: Sequence[str],
    measurement: str = "measurement",
    timestamp: str = "timestamp",
    ranges: ReadingRanges = ReadingRanges(),
) -> DataFrame:
    """Per sensor: readings of each class, mean of the valid ones, time of the last one."""
    value = F.col(measurement)
    kind = reading_class(value, ranges)
    return readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(kind == name).alias(f"n_{name}") for name in CLASSES],
        F.avg(valid_or_null(value)).alias("average_valid"),
        F.max(timestamp).alias("last_seen"),
    )


def with_status(
    counts: DataFrame,
    as_of: Column | datetime.datetime,
    horizon: datetime.timedelta = HOUR,
    min_valid_ratio: float = 0.5,
) -> DataFrame:
    """Add ``valid_ratio`` and ``status``: ``offline``, else ``faulty``, else ``ok``."""
    ratio = F.col("n_normal") / F.col("n")
    offline = F.col("last_seen").isNull() | (F.col("last_seen") < _column(as_of) - F.lit(horizon))
    status = F.when(offline, "offline").when(ratio < min_valid_ratio, "faulty").otherwise("ok")
    return counts.withColumns({"valid_ratio": ratio, "status": status})


def sensor_health(
    readings: DataFrame,
    keys: Sequence[str],
    as_of: Column | datetime.datetime | None = None,
    horizon: datetime.timedelta = HOUR,
    min_valid_ratio: float = 0.5,
    timestamp: str = "timestamp",
) -> DataFrame:
    """Health of every sensor at ``as_of``; by default at the time of the newest reading.

    Readings after ``as_of`` do not count; those without a time do.
    """
    if as_of is None:
        as_of = newest(readings, timestamp)
    else:
        readings = known_at(readings, as_of, timestamp)
    counts = health_counts(readings, keys, timestamp=timestamp)
    return with_status(counts, as_of, horizon, min_valid_ratio)


def bucket_means(
    readings: DataFrame,
    keys: Sequence[str],
    width: str = "1 hour",
    measurement: str = "measurement",
    timestamp: str = "timestamp",
) -> DataFrame:
    """Mean reading per sensor and time bucket, over all readings and over the valid ones.

    A reading without a time belongs to no bucket.
    """
    value = F.col(measurement)
    means = readings.groupBy(*keys, F.window(timestamp, width)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~is_invalid(value)).alias("n_valid"),
        F.avg(value).alias("average_measurement"),
        F.avg(valid_or_null(value)).alias("average_valid"),
    )
    return means.select(
        *keys,
        F.col("window.start").alias("bucket"),
        "n",
        "n_valid",
        "average_measurement",
        "average_valid",
    )


def last_readings(
    readings: DataFrame,
    keys: Sequence[str],
    measurement: str = "measurement",
    timestamp: str = "timestamp",
    repeatable: bool = False,
) -> DataFrame:
    """Time and value of the last reading of every sensor.

    When a sensor has several readings at its last instant, any of them may be
    taken; ``repeatable`` takes the largest, at the price of a sort.
    """
    grouped = readings.groupBy(*keys)
    if repeatable:
        last = grouped.agg(last_of(F.col(measurement), F.col(timestamp)).alias("_last"))
        return last.select(
            *keys,
            F.col("_last.timestamp").alias("last_seen"),
            F.col("_last.measurement").alias("last_measurement"),
        )
    return grouped.agg(
        F.max(timestamp).alias("last_seen"),
        F.max_by(measurement, timestamp).alias("last_measurement"),
    )


def online_at(
    last: DataFrame, as_of: Column | datetime.datetime, horizon: datetime.timedelta = HOUR
) -> DataFrame:
    """Sensors whose last reading lies within the horizon before ``as_of``.

    ``last`` must know no later readings: take it from ``known_at``.
    """
    now, seen = _column(as_of), F.col("last_seen")
    return last.where((seen >= now - F.lit(horizon)) & (seen <= now))


def sensors_online(
    readings: DataFrame,
    keys: Sequence[str],
    as_of: Column | datetime.datetime | None = None,
    horizon: datetime.timedelta = HOUR,
    measurement: str = "measurement",
    timestamp: str = "timestamp",
) -> DataFrame:
    """Sensors online at ``as_of`` with their last reading up to then.

    A sensor is online exactly when it has a reading inside the horizon, so the
    horizon filters the readings first: the bounds are constants of the time
    column's own type, and the scan can skip all older data. Of several readings
    at the last instant the largest is shown.
    """
    seen = F.col(timestamp)
    if as_of is None:
        # One subquery gives the finished bound; nothing is newer than the newest.
        recent = readings.where(
            seen >= readings.agg(F.max(timestamp) - F.lit(horizon)).scalar()
        )
    else:
        now = _column(as_of).cast(readings.schema[timestamp].dataType)
        recent = readings.where((seen >= now - F.lit(horizon)) & (seen <= now))
    return last_readings(recent, keys, measurement, timestamp, repeatable=True)


def known_at(
    readings: DataFrame, as_of: Column | datetime.datetime, timestamp: str = "timestamp"
) -> DataFrame:
    """Readings up to ``as_of``, and those without a time; a plain comparison that reaches the scan."""
    seen = F.col(timestamp)
    now = _column(as_of).cast(readings.schema[timestamp].dataType)
    return readings.where(seen.isNull() | (seen <= now))


def newest(readings: DataFrame, timestamp: str = "timestamp") -> Column:
    """The newest reading time as a scalar subquery over that one column."""
    return readings.agg(F.max(timestamp)).scalar()


def _column(moment: Column | datetime.datetime) -> Column:
    return moment if isinstance(moment, Column) else F.lit(moment)
