"""A message topic as a stream; needs the public Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def kafka_options(
    servers: str, topic: str, starting: str = "earliest", **extra: str
) -> dict[str, str]:
    """Source options. ``extra`` takes connector options such as ``maxOffsetsPerTrigger``,
    or ``minPartitions`` to read one large topic partition with several tasks."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        **extra,
    }


def read_kafka(
    spark: SparkSession, servers: str, topic: str, starting: str = "earliest", **extra: str
) -> DataFrame:
    """The topic's messages; the payload is the binary ``value`` column."""
    options = kafka_options(servers, topic, starting, **extra)
    return spark.readStream.format("kafka").options(**options).load()
