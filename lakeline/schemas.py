"""Schemas of the logical tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

#: A reading as the lake files hold it.
READING = T.StructType(
    [
        T.StructField("sensor_type", T.StringType()),
        T.StructField("measurement", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

#: Where the readers put the text of a line that does not fit the schema.
DAMAGED = "_damaged"


def with_damaged(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(DAMAGED, T.StringType())])


def lake_schema(keys: Sequence[str] = (), schema: T.StructType = READING) -> T.StructType:
    """The schema of lake files that begin with further text columns, such as a sensor's id."""
    extra = [T.StructField(k, T.StringType()) for k in keys if k not in schema.names]
    return T.StructType([*extra, *schema.fields])


#: Rows of files that stand in for a message topic.
MESSAGE = T.StructType([T.StructField("value", T.StringType())])


def row_image(
    measurement_type: str = "float", extra: Sequence[T.StructField] = ()
) -> T.StructType:
    """The changed row inside a change envelope; its time is epoch microseconds.

    The measurement narrows to 32 bits unless ``measurement_type="double"``.
    """
    measurement = {"float": T.FloatType(), "double": T.DoubleType()}[measurement_type]
    return T.StructType(
        [
            *extra,
            T.StructField("sensor_type", T.StringType()),
            T.StructField("measurement", measurement),
            T.StructField("timestamp", T.LongType()),
        ]
    )


def document_image(extra: Sequence[T.StructField] = ()) -> T.StructType:
    """The changed document; its time is text without a zone."""
    return T.StructType(
        [
            *extra,
            T.StructField("sensor_type", T.StringType()),
            T.StructField("measurement", T.DoubleType()),
            T.StructField("timestamp", T.StringType()),
        ]
    )


def envelope(after: T.DataType) -> T.StructType:
    """A change message: ``payload.op`` and ``payload.after``."""
    payload = T.StructType([T.StructField("op", T.StringType()), T.StructField("after", after)])
    return T.StructType([T.StructField("payload", payload)])
