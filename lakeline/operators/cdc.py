"""Change-data-capture envelopes to rows, in batch and on a stream alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.functions.times import micros_to_timestamp
from lakeline.schemas import DAMAGED, document_image, envelope, row_image


def decode_envelopes(
    messages: DataFrame,
    measurement_type: str = "float",
    precision: str = "second",
    source_zone: str = "UTC",
    extra: Sequence[T.StructField] = (),
    value: str = "value",
) -> DataFrame:
    """Decode ``payload.after`` structs; ``timestamp`` becomes an instant.

    Every message gives one row. Deletes, tombstones and garbage give a row of
    NULLs with ``has_row = false``; ``op`` tells the kind of change.
    """
    parsed = _parsed(messages, envelope(row_image(measurement_type, extra)), value)
    has_row = F.col("data.payload.after").isNotNull().alias("has_row")
    return (
        parsed.select("data.payload.after.*", _op(), has_row)
        .withColumn("timestamp", micros_to_timestamp(F.col("timestamp"), precision, source_zone))
    )


def decode_document_envelopes(
    messages: DataFrame,
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
    extra: Sequence[T.StructField] = (),
    value: str = "value",
) -> DataFrame:
    """Decode envelopes of a document store, whose ``after`` is a document as JSON text.

    A document that cannot be read gives a row of NULLs with ``has_row = false``, like
    a message without one. A single field that does not fit its type damages it all.
    """
    parsed = _parsed(messages, envelope(T.StringType()), value)
    image = document_image(extra)
    schema = T.StructType([*image.fields, T.StructField(DAMAGED, T.StringType())])
    read = F.from_json("data.payload.after", schema, {"columnNameOfCorruptRecord": DAMAGED})
    documents = parsed.select(read.alias("document"), _op())
    has_row = F.col("document").isNotNull() & F.col(f"document.{DAMAGED}").isNull()
    fields = [F.when(F.col("has_row"), F.col(f"document.{n}")).alias(n) for n in image.names]
    return (
        documents.withColumn("has_row", has_row)
        .select(*fields, "op", "has_row")
        .withColumn("timestamp", F.try_to_timestamp("timestamp", F.lit(timestamp_format)))
    )


def _parsed(messages: DataFrame, schema: T.StructType, value: str) -> DataFrame:
    return messages.select(F.from_json(F.col(value).cast("string"), schema).alias("data"))


def _op() -> Column:
    return F.col("data.payload.op").alias("op")


def changed_rows(decoded: DataFrame) -> DataFrame:
    """Only messages that carry a row."""
    return decoded.where("has_row")
