"""Refresh sensor metrics from the lake directory, from all of it or from its new files."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakeline.config import Target
from lakeline.operators.dashboard import dashboard_tables
from lakeline.operators.rollup import rollup
from lakeline.operators.sensors import HOUR, known_at
from lakeline.schemas import READING
from lakeline.session import scratch_path
from lakeline.sinks.files import remove
from lakeline.sinks.stores import write_metrics
from lakeline.sources.files import read_sensor_lake, stream_sensor_lake
from lakeline.streaming.dashboard import start_dashboard
from lakeline.streaming.jobs import DRAIN, Trigger

def lake_metrics(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = ("sensor_type",),
    as_of: Column | datetime.datetime | None = None,
    horizon: datetime.timedelta = HOUR,
    width: str = "1 hour",
    staging: str | None = None,
    repeatable: bool = False,
    schema: StructType = READING,
) -> dict[str, DataFrame]:
    """Every dashboard table over all files of the directory.

    With ``as_of`` the tables show what was known then: later readings do not count.
    Of several readings of a sensor at its last instant any is shown; ``repeatable``
    takes the largest, which sorts all readings. ``schema`` names the columns of the
    files, so that ``keys`` may be columns of their own.

    The files are read and parsed once, into a rollup stored as Parquet at
    ``staging`` (by default in the shared scratch folder); the tables are lazy
    and read only that.
    """
    staging = staging or scratch_path(spark, "rollup")
    readings = read_sensor_lake(spark, path, schema)
    if as_of is not None:
        readings = known_at(readings, as_of)
    rollup(readings, keys, width, repeatable=repeatable).write.parquet(staging)
    return dashboard_tables(spark.read.parquet(staging), keys, as_of, horizon)


def refresh(
    metrics: Mapping[str, DataFrame], targets: Mapping[str, Sequence[Target]]
) -> None:
    """Replace each named metric in its targets."""
    for name, stores in targets.items():
        write_metrics(metrics[name], stores)


def refresh_from_lake(
    spark: SparkSession,
    path: str,
    targets: Mapping[str, Sequence[Target]],
    keys: Sequence[str] = ("sensor_type",),
    **options: object,
) -> None:
    """Read the lake once, replace every table, and remove the rollup."""
    staging = scratch_path(spark, "rollup")
    try:
        refresh(lake_metrics(spark, path, keys, staging=staging, **options), targets)
    finally:
        remove(spark, staging)


def start_lake_updates(
    spark: SparkSession,
    path: str,
    targets: Mapping[str, Sequence[Target]],
    checkpoint: str,
    keys: Sequence[str] = ("sensor_type",),
    trigger: Trigger = DRAIN,
    schema: StructType = READING,
    source: Mapping[str, str] | None = None,
    **options: object,
) -> StreamingQuery:
    """Bring the dashboard tables up to date with files not read before.

    One query reads and parses each file once; ``checkpoint`` keeps the names of the
    files and the rollups of what they held, see ``start_dashboard`` for ``options``.
    ``source`` takes options of the file source.
    """
    readings = stream_sensor_lake(spark, path, schema, **(source or {}))
    return start_dashboard(readings, targets, checkpoint, keys, trigger, **options)
