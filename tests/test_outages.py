"""Segments of readings and the outages between them."""

from __future__ import annotations

import datetime
import random

from helpers import rows
from pyspark.sql import functions as F

from lakeline.operators.outages import merge_segments, online_segments, outages, sensor_outages

T0 = datetime.datetime(2024, 9, 1, 22)
KEYS = ["sensor_id"]


def minute(n):
    return T0 + datetime.timedelta(minutes=n)


def table(spark, *found):
    pairs = [(s, None if m is None else minute(m)) for s, m in found]
    return spark.createDataFrame(pairs, "sensor_id string, timestamp timestamp_ntz")


def test_gaps_longer_than_the_horizon_are_outages(spark):
    # Sensor a runs on across midnight; gaps of exactly an hour are none; c is silent at the end.
    found = [("a", m) for m in (0, 60, 119, 130, 300, 301)] + [("b", 250), ("b", 300), ("c", 10), ("c", None)]
    got = sensor_outages(table(spark, *found), KEYS).orderBy("sensor_id").collect()
    assert [(r.sensor_id, r.silent_since, r.back_at, r.seconds) for r in got] == [
        ("a", minute(130), minute(300), 170 * 60),
        ("c", minute(10), None, 291 * 60),
    ]
    assert sensor_outages(table(spark), KEYS).count() == 0


def test_segments_of_parts_merge_to_those_of_all(spark):
    draw = random.Random(3)
    found = [(draw.choice("abc"), draw.randrange(6000)) for _ in range(400)] + [("d", 5), ("d", 5)]
    readings = table(spark, *found)
    whole = merge_segments(online_segments(readings, KEYS), KEYS)
    for deal in (F.pmod(F.xxhash64("timestamp"), F.lit(3)), F.hour("timestamp") % 2):
        parts = None
        for part in range(3):
            own = online_segments(readings.where(deal == part), KEYS)
            parts = own if parts is None else parts.unionByName(own)
        merged = merge_segments(parts, KEYS)
        assert rows(merged) == rows(whole)
        # Merging is repeatable, but for the counts.
        assert rows(merge_segments(merged, KEYS)) == rows(whole)
    assert sum(r.n for r in whole.collect()) == len(found)
    now = F.lit(minute(6000))
    assert outages(whole, KEYS, now).where("sensor_id = 'd'").count() == 1
