"""Epoch microseconds, zone-less wall clocks and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_to_timestamp(
    micros: Column, precision: str = "second", source_zone: str = "UTC"
) -> Column:
    """Epoch microseconds as a timestamp.

    ``precision="second"`` truncates toward zero. ``source_zone`` names the zone
    of the wall clock the producer encoded: change-data-capture writes a zone-less
    column as if it were UTC, so any other zone shifts the result to the true
    instant. No text round trip takes place, so daylight-saving overlaps are exact.
    """
    if precision == "second":
        instant = F.timestamp_seconds(F.call_function("div", micros, F.lit(1_000_000)))
    elif precision == "micro":
        instant = F.timestamp_micros(micros)
    else:
        raise ValueError(f"precision must be 'second' or 'micro', not {precision!r}")
    if source_zone == "UTC":
        return instant
    return F.to_utc_timestamp(instant, source_zone)


def wall_clock_to_micros(wall_clock: Column) -> Column:
    """A zone-less timestamp as epoch microseconds, whatever the session zone."""
    since_epoch = wall_clock.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = since_epoch.cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")
