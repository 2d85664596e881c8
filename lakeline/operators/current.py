"""The current rows of a table from its changes: the last change of a key wins."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.functions.times import micros_to_timestamp
from lakeline.schemas import document_image, row_image

#: What a folded change carries beside its row.
POSITION, DELETED, CHANGED_AT = "position", "deleted", "changed_at"
BOOKKEEPING = (POSITION, DELETED, CHANGED_AT)
DELETE = "d"


def decode_changes(
    messages: DataFrame,
    keys: Sequence[T.StructField],
    order: Sequence[str] = ("lsn",),
    documents: bool = False,
    measurement_type: str = "float",
    precision: str = "second",
    source_zone: str = "UTC",
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
    extra: Sequence[T.StructField] = (),
    value: str = "value",
    message_key: str | None = None,
) -> DataFrame:
    """Changes with their key, row, ``position`` in the source's log, ``deleted``, ``changed_at``.

    ``order`` names numbers under ``payload.source`` that together rise with every change
    of the source: ``lsn`` of a relational log, ``ts_ms`` and ``ord`` of a document store. A
    deletion has its key from ``payload.before``, or from ``payload`` of the message's own
    key, in the column ``message_key``. With ``documents`` images are JSON text.

    Tombstones, damaged messages and those without key or position are left out: a
    deletion has a message of its own in front of its tombstone.
    """
    fields = [*keys, *extra]
    image = document_image(fields) if documents else row_image(measurement_type, fields)
    image_type = T.StringType() if documents else image
    source = T.StructType([T.StructField(n, T.LongType()) for n in dict.fromkeys([*order, "ts_ms"])])
    payload = T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("before", image_type),
            T.StructField("after", image_type),
            T.StructField("source", source),
        ]
    )
    envelope = T.StructType([T.StructField("payload", payload)])
    key_type = T.StructType([T.StructField("payload", T.StructType(list(keys)))])
    parsed = messages.select(
        F.from_json(F.col(value).cast("string"), envelope)["payload"].alias("data"),
        (
            F.from_json(F.col(message_key).cast("string"), key_type)["payload"]
            if message_key
            else F.lit(None).cast(T.StructType(list(keys)))
        ).alias("key"),
    )
    for side in ("before", "after"):
        row = F.col(f"data.{side}")
        parsed = parsed.withColumn(side, F.from_json(row, image) if documents else row)
    deleted = F.col("data.op") == DELETE
    own = [
        F.coalesce(F.col(f"after.{k.name}"), F.col(f"before.{k.name}"), F.col(f"key.{k.name}")).alias(k.name)
        for k in keys
    ]
    named = {k.name for k in keys}
    row = [
        F.when(~deleted, F.col(f"after.{n}")).alias(n) for n in image.names if n not in named | {"timestamp"}
    ]
    seen = F.col("after.timestamp")
    if documents:
        seen = F.try_to_timestamp(seen, F.lit(timestamp_format))
    else:
        seen = micros_to_timestamp(seen, precision, source_zone)
    position = F.struct(*[F.col(f"data.source.{n}").alias(n) for n in order])
    changes = parsed.select(
        *own,
        *row,
        F.when(~deleted, seen).alias("timestamp"),
        position.alias(POSITION),
        deleted.alias(DELETED),
        F.timestamp_millis("data.source.ts_ms").alias(CHANGED_AT),
    )
    placed = [F.col(f"{POSITION}.{n}").isNotNull() for n in order]
    known = [F.col(k).isNotNull() for k in named]
    whole = F.col(DELETED).isNotNull()
    for condition in (*placed, *known):
        whole = whole & condition
    return changes.where(whole)


def fold_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last change of every key by its position; deletions stay as rows of their own.

    Folding is a partial aggregate, so a key that changes all the time leaves a task as
    one row. The result can be folded again with further changes, in any order and
    more than once: an older change never overtakes a newer one, nor a deletion.
    """
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), POSITION).alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, "_last.*").select(changes.columns)


def forget_deletions(
    folded: DataFrame, retention: datetime.timedelta, changed_at: str = CHANGED_AT
) -> DataFrame:
    """Without deletions older than the newest change by ``retention``.

    No change may arrive later than that, or it would bring a deleted row back.
    """
    newest = folded.agg(F.max(changed_at)).scalar()
    old = F.col(DELETED) & (F.col(changed_at) < newest - F.lit(retention))
    return folded.where(~F.coalesce(old, F.lit(False)))


def current_rows(folded: DataFrame) -> DataFrame:
    """The rows that are there now, without what folding needs."""
    return folded.where(~F.col(DELETED)).drop(*BOOKKEEPING)


def rows_at(changes: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """The rows as they were at a position of the source's log, from all changes."""
    return current_rows(fold_changes(changes.where(F.col(POSITION) <= position), keys))
