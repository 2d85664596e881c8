"""A table kept current by a stream of its changes."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lakeline.config import Target
from lakeline.operators.current import current_rows, fold_changes, forget_deletions
from lakeline.sinks.stores import write_version
from lakeline.streaming.jobs import Trigger, start_writer
from lakeline.streaming.runs import RunStore


def current_store(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    fold: int = 8,
    retention: datetime.timedelta | None = None,
) -> RunStore:
    """Folded changes in tiers; with ``retention`` merges of the oldest forget old deletions."""

    def merge(changes: DataFrame, oldest: bool) -> DataFrame:
        folded = fold_changes(changes, keys)
        return forget_deletions(folded, retention) if retention is not None and oldest else folded

    return RunStore(spark, path, merge, fold)


def read_current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The current rows from the folder of ``start_current_table``, whatever is written meanwhile."""
    folded = current_store(spark, path, keys).rows()
    if folded is None:
        raise ValueError(f"{path} holds no changes yet")
    return current_rows(folded)


def start_current_table(
    changes: DataFrame,
    keys: Sequence[str],
    path: str,
    checkpoint: str,
    trigger: Trigger | None = None,
    targets: Sequence[Target] = (),
    fold: int = 8,
    retention: datetime.timedelta | None = None,
) -> StreamingQuery:
    """Fold every micro-batch of ``decode_changes`` into the table stored at ``path``.

    A micro-batch writes the last change of each of its keys, and runs are merged in
    tiers, so the work of a batch follows the changes and not the size of the table.
    Late and repeated messages change nothing that is newer. ``targets`` get the whole
    table after every micro-batch, if there are any.
    """

    def save_batch(batch: DataFrame, batch_id: int) -> None:
        store = current_store(batch.sparkSession, path, keys, fold, retention)
        store.add(fold_changes(batch, keys), batch_id)
        if targets:
            write_version(current_rows(store.rows()), targets, batch_id)

    return start_writer(changes.writeStream.foreachBatch(save_batch), checkpoint, trigger)
