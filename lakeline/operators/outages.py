"""When sensors were silent: segments of readings that can be merged, and the gaps between them."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.operators.sensors import HOUR, newest

BEGAN, ENDED = "began", "ended"


def online_segments(
    readings: DataFrame,
    keys: Sequence[str],
    horizon: datetime.timedelta = HOUR,
    timestamp: str = "timestamp",
) -> DataFrame:
    """Stretches of each sensor's readings that follow each other within the horizon: ``began, ended, n``.

    Each calendar day of a sensor is cut by itself, so that one sensor's history is the
    work of many tasks; ``merge_segments`` joins what belongs together. Readings without a
    time belong to none.
    """
    timed = readings.where(F.col(timestamp).isNotNull()).select(
        *keys, F.col(timestamp).alias(BEGAN), F.col(timestamp).alias(ENDED), F.lit(1).cast("long").alias("n")
    )
    return _joined(timed.withColumn("_day", F.to_date(BEGAN)), [*keys, "_day"], horizon).drop("_day")


def merge_segments(
    segments: DataFrame, keys: Sequence[str], horizon: datetime.timedelta = HOUR
) -> DataFrame:
    """The segments of all readings from those of parts of them, in whatever way they were dealt to parts.

    A part's segment lies within one of the whole, so segments that come within the
    horizon of each other are one. There are few for each sensor: one a day at least, and
    one for each outage.
    """
    return _joined(segments.select(*keys, BEGAN, ENDED, "n"), list(keys), horizon)


def _joined(segments: DataFrame, groups: Sequence[str], horizon: datetime.timedelta) -> DataFrame:
    """Segments of a group that overlap or follow within the horizon, as one."""
    order = Window.partitionBy(*groups).orderBy(BEGAN, ENDED)
    reached = F.max(ENDED).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = (reached.isNull() | (F.col(BEGAN) > reached + F.lit(horizon))).cast("int")
    numbered = segments.withColumn("_first", first).withColumn("_island", F.sum("_first").over(order))
    return (
        numbered.groupBy(*groups, "_island")
        .agg(F.min(BEGAN).alias(BEGAN), F.max(ENDED).alias(ENDED), F.sum("n").alias("n"))
        .drop("_island")
    )


def outages(
    segments: DataFrame, keys: Sequence[str], as_of: Column | datetime.datetime, horizon: datetime.timedelta = HOUR
) -> DataFrame:
    """The gaps between merged segments: ``silent_since``, ``back_at``, ``seconds``.

    A sensor whose last reading is older than the horizon at ``as_of`` is still silent:
    ``back_at`` is NULL, and the seconds count up to then.
    """
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    order = Window.partitionBy(*keys).orderBy(BEGAN)
    gaps = segments.select(*keys, F.col(ENDED).alias("silent_since"), F.lead(BEGAN).over(order).alias("back_at"))
    gaps = gaps.withColumn("_now", now)
    silent = F.col("back_at").isNotNull() | (F.col("silent_since") < F.col("_now") - F.lit(horizon))
    until = F.coalesce("back_at", F.col("_now"))
    seconds = F.timestamp_diff("SECOND", F.col("silent_since"), until)
    return gaps.where(silent).withColumn("seconds", seconds).drop("_now")


def sensor_outages(
    readings: DataFrame,
    keys: Sequence[str],
    horizon: datetime.timedelta = HOUR,
    timestamp: str = "timestamp",
) -> DataFrame:
    """Every time a sensor was silent for longer than the horizon, up to the newest reading of all."""
    segments = merge_segments(online_segments(readings, keys, horizon, timestamp), keys, horizon)
    return outages(segments, keys, newest(readings, timestamp), horizon)
