"""What a single sensor reading means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the reading a burnt-out sensor sends.
INVALID_MARK = -1

CLASSES = ("invalid", "normal", "outlier", "unexpected")


@dataclass(frozen=True)
class ReadingRanges:
    """Inclusive bounds of the normal and the outlier readings."""

    normal: tuple[float, float] = (80, 100)
    outlier: tuple[float, float] = (20, 45)


def is_invalid(measurement: Column) -> Column:
    """True for a missing reading or the burnt-out mark; never NULL."""
    return measurement.isNull() | (measurement == INVALID_MARK)


def valid_or_null(measurement: Column) -> Column:
    return F.when(~is_invalid(measurement), measurement)


def reading_class(measurement: Column, ranges: ReadingRanges = ReadingRanges()) -> Column:
    """``invalid``, ``normal``, ``outlier`` or ``unexpected``."""
    return (
        F.when(is_invalid(measurement), "invalid")
        .when(measurement.between(*ranges.normal), "normal")
        .when(measurement.between(*ranges.outlier), "outlier")
        .otherwise("unexpected")
    )


def last_of(measurement: Column, timestamp: Column) -> Column:
    """Aggregate: the last reading as ``(timestamp, measurement)``, the largest of several at once.

    Its buffer is a struct, which makes Spark sort before it aggregates.
    """
    reading = F.struct(timestamp.alias("timestamp"), measurement.alias("measurement"))
    return F.max(F.when(timestamp.isNotNull(), reading))
