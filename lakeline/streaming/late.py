"""Closed buckets of a stream, with the rows that came too late for theirs."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeline.config import Target
from lakeline.operators.rollup import merge_rollups, rollup, total_means
from lakeline.sinks.files import children, is_committed, remove
from lakeline.sinks.stores import write_batch
from lakeline.streaming.jobs import Trigger, start_writer

MARK = "watermark"


class OpenBuckets:
    """The rollup of buckets that are still open, and the watermark, by batch in a shared folder.

    A state counts when it is complete. A batch goes on from the newest state before it
    and overwrites its own, so a repeat gives the same; the state before is kept for that.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]) -> None:
        self._spark = spark
        self._path = path.rstrip("/")
        self._keys = list(keys)

    def before(self, batch_id: int | None = None) -> tuple[DataFrame | None, datetime.datetime | None]:
        """The open buckets and the watermark that a batch finds, or those of now."""
        found = [v for v in self._versions() if batch_id is None or v < batch_id]
        if not found:
            return None, None
        state = self._spark.read.parquet(self._at(max(found)))
        mark = state.agg(F.max(MARK)).first()[0]
        return state.where(F.col("bucket").isNotNull()).drop(MARK), mark

    def save(self, totals: DataFrame, mark: datetime.datetime | None, batch_id: int) -> None:
        lone = self._spark.createDataFrame([(mark,)], f"{MARK} timestamp")
        state = totals.unionByName(lone, allowMissingColumns=True)
        state.write.mode("overwrite").parquet(self._at(batch_id))
        for version in sorted(v for v in self._versions() if v < batch_id)[:-1]:
            remove(self._spark, self._at(version))

    def _versions(self) -> list[int]:
        names = [n for n in children(self._spark, self._path) if n.startswith("state-")]
        return [int(n.removeprefix("state-")) for n in names if is_committed(self._spark, f"{self._path}/{n}")]

    def _at(self, version: int) -> str:
        return f"{self._path}/state-{version}"


def start_closed_buckets(
    readings: DataFrame,
    keys: Sequence[str],
    targets: Sequence[Target],
    late_targets: Sequence[Target],
    checkpoint: str,
    width: datetime.timedelta = datetime.timedelta(hours=1),
    lateness: datetime.timedelta = datetime.timedelta(minutes=10),
    trigger: Trigger | None = None,
    timestamp: str = "timestamp",
) -> StreamingQuery:
    """Bucket means once their bucket is closed, to ``targets``, and every row that came after that,
    to ``late_targets``; both as batches that a repeat leaves as they are.

    A bucket closes when its end is older by ``lateness`` than the newest reading so far.
    A reading whose bucket closed in an earlier micro-batch is late; one without a time
    has no bucket and goes there too. So each row is in a closed bucket, in an open one
    (``open_buckets``) or among the late ones, exactly once. State are the open
    buckets alone. The engine's own watermark drops such rows without a trace, see
    ``windowed_means``.
    """
    span = f"{int(width.total_seconds())} seconds"

    def save_batch(batch: DataFrame, batch_id: int) -> None:
        state = OpenBuckets(batch.sparkSession, f"{checkpoint}/open", keys)
        held, mark = state.before(batch_id)
        time = F.col(timestamp)
        # A window leaves out rows without a time, so they get a stand-in.
        stand_in = F.lit(0).cast("timestamp").cast(batch.schema[timestamp].dataType)
        end = F.window(F.coalesce(time, stand_in), span)["end"]
        on_time = time.isNotNull() & (F.lit(True) if mark is None else end > F.lit(mark))
        kept = rollup(batch.where(on_time), keys, span, timestamp=timestamp)
        both = kept if held is None else held.unionByName(kept)
        newest = batch.agg(F.max(timestamp)).first()[0]
        if newest is not None:
            mark = max(newest - lateness, mark or newest - lateness)
        merged = merge_rollups(both, keys)
        closed = _ended(width, mark)
        for target in targets:
            write_batch(total_means(merged.where(closed), keys), target, batch_id, [*keys, "bucket"])
        for target in late_targets:
            write_batch(batch.where(~on_time), target, batch_id, batch.columns)
        state.save(merged.where(~closed), mark, batch_id)

    return start_writer(readings.writeStream.foreachBatch(save_batch), f"{checkpoint}/query", trigger)


def _ended(width: datetime.timedelta, mark: datetime.datetime | None) -> Column:
    return F.lit(False) if mark is None else F.col("bucket") + F.lit(width) <= F.lit(mark)


def open_buckets(spark: SparkSession, checkpoint: str, keys: Sequence[str]) -> DataFrame | None:
    """The means of the buckets that are still open; None before the first batch."""
    held, _ = OpenBuckets(spark, f"{checkpoint}/open", keys).before()
    return None if held is None else total_means(held, keys)
