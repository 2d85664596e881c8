"""Streaming jobs over sensor readings.

Every job needs a checkpoint folder all executors share, and resumes from it.
``trigger`` takes the keyword arguments of ``DataStreamWriter.trigger``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from lakeline.config import TIMESTAMP_FORMAT, Target
from lakeline.operators.sensors import bucket_means, sensor_metrics
from lakeline.sinks.stores import BATCH, write_metrics, write_version

Trigger = Mapping[str, object]

#: Work through everything available now, in bounded micro-batches, then stop.
DRAIN: Trigger = {"availableNow": True}


def windowed_means(
    readings: DataFrame,
    keys: Sequence[str],
    width: str = "1 hour",
    lateness: str = "10 minutes",
    timestamp: str = "timestamp",
) -> DataFrame:
    """Bucket means on a stream: a bucket closes, and its state goes, ``lateness`` after its end.

    Readings older than that are dropped. The time column must be a TIMESTAMP.
    """
    return bucket_means(
        readings.withWatermark(timestamp, lateness), keys, width, timestamp=timestamp
    )


def start_running_metrics(
    readings: DataFrame,
    targets: Sequence[Target],
    checkpoint: str,
    trigger: Trigger | None = None,
    history: bool = True,
) -> StreamingQuery:
    """Cumulative metrics over all readings so far, saved to every target per micro-batch.

    The state is one row. No watermark applies, so late readings count too.
    With ``history`` each micro-batch adds its row, else it is a new version of the last one.
    """

    def save_batch(metrics: DataFrame, batch_id: int) -> None:
        if history:
            write_metrics(metrics, targets, batch_id)
        else:
            write_version(metrics, targets, batch_id)

    writer = sensor_metrics(readings).writeStream.outputMode("complete").foreachBatch(save_batch)
    return start_writer(writer, checkpoint, trigger)


def start_json_sink(
    rows: DataFrame, path: str, checkpoint: str, trigger: Trigger | None = None
) -> StreamingQuery:
    """Append rows, or closed buckets, to JSON files exactly once."""
    writer = (
        rows.writeStream.outputMode("append")
        .format("json")
        .option("path", path)
        .option("timestampFormat", TIMESTAMP_FORMAT)
    )
    return start_writer(writer, checkpoint, trigger)


def start_keyed_state(
    aggregated: DataFrame,
    keys: Sequence[str],
    targets: Sequence[Target],
    checkpoint: str,
    trigger: Trigger | None = None,
    history: bool = True,
) -> StreamingQuery:
    """Save a keyed aggregate, such as health or last readings per sensor, per micro-batch.

    With ``history`` only the sensors that changed are written, and ``latest_state``
    reads the current row of each; the stored batches add up. Without it every
    micro-batch saves the whole state as a new version, see ``write_version``.
    """

    def save_batch(rows: DataFrame, batch_id: int) -> None:
        if history:
            write_metrics(rows, targets, batch_id, keys)
        else:
            write_version(rows, targets, batch_id)

    mode = "update" if history else "complete"
    writer = aggregated.writeStream.outputMode(mode).foreachBatch(save_batch)
    return start_writer(writer, checkpoint, trigger)


def latest_state(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the newest batch for every key."""
    values = [c for c in stored.columns if c not in (*keys, BATCH)]
    return stored.groupBy(*keys).agg(*[F.max_by(c, BATCH).alias(c) for c in values])


def run_to_end(query: StreamingQuery) -> None:
    """Wait until a draining query has stopped; its failure is raised here."""
    query.awaitTermination()


def start_writer(
    writer: DataStreamWriter, checkpoint: str, trigger: Trigger | None
) -> StreamingQuery:
    """Start a query that resumes from its checkpoint."""
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("checkpointLocation", checkpoint).start()
