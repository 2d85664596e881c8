"""The tables of the sensor dashboard, from a rollup."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from lakeline.operators.rollup import total_health, total_last, total_means, total_metrics
from lakeline.operators.sensors import HOUR, newest, online_at, with_status
from lakeline.operators.smoothing import smooth

TABLES = (
    "sensor_metrics",
    "sensor_health",
    "sensor_buckets",
    "sensor_smoothing",
    "sensors_online",
)


def dashboard_tables(
    totals: DataFrame,
    keys: Sequence[str],
    as_of: Column | datetime.datetime | None = None,
    horizon: datetime.timedelta = HOUR,
) -> dict[str, DataFrame]:
    """The dashboard tables, at the time of the newest reading by default."""
    now = newest(totals, "last_seen") if as_of is None else as_of
    means = total_means(totals, keys)
    tables = (
        total_metrics(totals),
        with_status(total_health(totals, keys), now, horizon),
        means,
        smooth(means, keys),
        online_at(total_last(totals, keys), now, horizon),
    )
    return dict(zip(TABLES, tables, strict=True))
