"""Move sensor readings between stores and report on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession

from lakeline.config import Target
from lakeline.operators.sensors import metric_columns, sensor_metrics
from lakeline.sinks.stores import save, write_metrics
from lakeline.sources.stores import read_whole


def migrate_readings(
    spark: SparkSession,
    source: Target,
    target: Target,
    metric_targets: Sequence[Target] = (),
    mode: str = "append",
) -> DataFrame:
    """Copy readings into another store and save their metrics, in a single pass.

    The metrics are observed on the rows while they are copied, so the source is
    not read again for them.
    """
    seen = Observation()
    readings = read_whole(spark, source)
    save(readings.observe(seen, *metric_columns()), target, mode)
    schema = sensor_metrics(readings).schema
    metrics = spark.createDataFrame([[seen.get[name] for name in schema.names]], schema)
    if metric_targets:
        write_metrics(metrics, metric_targets)
    return metrics
