"""Closed buckets and the rows that came too late for theirs."""

from __future__ import annotations

import datetime

from helpers import rows
from pyspark.sql import functions as F

from lakeline.config import TableTarget
from lakeline.sources.stores import read_target
from lakeline.streaming import open_buckets, start_closed_buckets
from lakeline.streaming.jobs import DRAIN, run_to_end

T0 = datetime.datetime(2024, 9, 1, 10)
READINGS = "sensor_type string, measurement double, timestamp timestamp"
KEYS = ["sensor_type"]


def test_every_row_is_kept_once(spark, folder):
    batches = [
        [("t", 80.0, 0), ("t", 90.0, 75)],  # the watermark comes to 11:05: the first bucket closes
        [("t", 84.0, 5), ("t", 91.0, 70), ("u", 50.0, 61), ("u", 85.0, None)],  # one is late, one has no time
        [("t", 92.0, 200)],  # closes the second bucket
        [("u", 93.0, 100), ("t", None, 181)],  # one is late, one in time
        [],
    ]
    closed, late = (TableTarget.parquet_files(folder(n)) for n in ("closed", "late"))

    def drain():
        stream = spark.readStream.schema(READINGS).parquet(folder("in"))
        run_to_end(start_closed_buckets(stream, KEYS, [closed], [late], folder("checkpoint"), trigger=DRAIN))

    for batch in batches:
        found = [(t, v, None if m is None else T0 + datetime.timedelta(minutes=m)) for t, v, m in batch]
        if found:
            spark.createDataFrame(found, READINGS).coalesce(1).write.mode("append").parquet(folder("in"))
        drain()
    means = read_target(spark, closed).select(*KEYS, F.hour("bucket"), "n", "average_measurement")
    assert rows(means) == [("t", 10, 1, 80.0), ("t", 11, 2, 90.5), ("u", 11, 1, 50.0)]
    lost = read_target(spark, late).select(*KEYS, "measurement", "batch_id")
    assert rows(lost) == [("t", 84.0, 1), ("u", 85.0, 1), ("u", 93.0, 3)]
    still = open_buckets(spark, folder("checkpoint"), KEYS)
    assert rows(still.select(*KEYS, F.hour("bucket"), "n")) == [("t", 13, 2)]
    total = sum(map(len, batches))
    kept = sum(r.n for r in read_target(spark, closed).collect()) + sum(r.n for r in still.collect())
    assert kept + lost.count() == total


def test_nothing_has_no_buckets(spark, folder):
    assert open_buckets(spark, folder("none"), KEYS) is None
