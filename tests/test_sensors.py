"""Sensor metrics, health, buckets, smoothing, rollup and the online test."""

from __future__ import annotations

import datetime
import random

import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeline.functions.readings import ReadingRanges, reading_class
from lakeline.operators.rollup import rollup, total_health, total_last, total_means, total_metrics
from lakeline.operators.sensors import (
    bucket_means,
    class_counts,
    health_counts,
    last_readings,
    sensor_health,
    sensor_metrics,
    sensors_online,
)
from lakeline.operators.smoothing import smooth

START = datetime.datetime(2024, 1, 31, 20)
MINUTE = datetime.timedelta(minutes=1)
READINGS = "sensor string, measurement double, timestamp timestamp"


@pytest.fixture(scope="module")
def readings(spark):
    """Half of 4000 readings come from one sensor; some are silent, burnt out, far off or undated."""
    rng = random.Random(7)
    values = [None, -1.0, 80.0, 100.0, 90.5, 20.0, 45.0, 45.5, 79.9, 0.0]
    data = [
        (
            "hot" if i % 2 else f"s{rng.randrange(40)}",
            rng.choice(values),
            START + i * MINUTE + rng.random() * MINUTE,
        )
        for i in range(4000)
    ]
    data += [("hot", 90.0, None), ("timeless", -1.0, None), (None, 30.0, START)]
    return spark.createDataFrame(data, READINGS).cache()


def test_classes_at_their_bounds(spark):
    values = [None, -1.0, 80.0, 100.0, 100.1, 20.0, 45.0, 45.1, 19.9, 0.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "m double")
    assert [r[0] for r in df.select(reading_class(F.col("m"))).collect()] == [
        "invalid", "invalid", "normal", "normal", "unexpected", "outlier", "outlier",
        "unexpected", "unexpected", "unexpected", "unexpected",
    ]
    narrow = reading_class(F.col("m"), ReadingRanges(normal=(0, 1), outlier=(2, 50)))
    assert df.where(narrow == "outlier").count() == 4


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], READINGS)
    assert rows(sensor_metrics(empty)) == [(None, 0, None)]
    assert rows(total_metrics(rollup(empty, ["sensor"]))) == [(None, 0, None)]
    assert rows(class_counts(empty)) == []


def test_metrics_of_invalid_readings_only(spark):
    df = spark.createDataFrame([("a", None, START), ("a", -1.0, START)], READINGS)
    assert rows(sensor_metrics(df)) == [(-1.0, 2, None)]
    assert rows(total_metrics(rollup(df, ["sensor"]))) == [(-1.0, 2, None)]


def test_health_status(spark):
    hour = datetime.timedelta(hours=1)
    df = spark.createDataFrame(
        [
            ("ok", 90.0, START),
            ("ok", -1.0, START),
            ("faulty", 90.0, START),
            ("faulty", 30.0, START),
            ("faulty", None, START),
            ("edge", 90.0, START - hour),
            ("gone", 90.0, START - hour - MINUTE),
        ],
        READINGS,
    )
    status = sensor_health(df, ["sensor"]).select("sensor", "valid_ratio", "status")
    assert rows(status.withColumn("valid_ratio", F.round("valid_ratio", 3))) == [
        ("edge", 1.0, "ok"),
        ("faulty", 0.333, "faulty"),
        ("gone", 1.0, "offline"),
        ("ok", 0.5, "ok"),
    ]
    later = sensor_health(df, ["sensor"], as_of=START + 2 * hour)
    assert {r.status for r in later.collect()} == {"offline"}
    strict = sensor_health(df, ["sensor"], min_valid_ratio=0.9, horizon=datetime.timedelta(days=1))
    assert dict(rows(strict.select("sensor", "status"))) == {
        "edge": "ok", "faulty": "faulty", "gone": "ok", "ok": "faulty",
    }


def test_online_is_what_the_last_reading_says(spark, readings):
    hour = datetime.timedelta(hours=1)
    newest = readings.agg(F.max("timestamp")).first()[0]
    for as_of in (newest, START + 900 * MINUTE, START):
        known = last_readings(readings.where(F.col("timestamp") <= as_of), ["sensor"])
        expected = rows(known.where(F.col("last_seen") >= as_of - hour))
        assert rows(sensors_online(readings, ["sensor"], as_of)) == expected
    assert rows(sensors_online(readings, ["sensor"])) == rows(
        sensors_online(readings, ["sensor"], newest)
    )


def test_online_bound_reaches_the_scan(spark, readings, folder):
    readings.write.parquet(folder("readings"))
    stored = spark.read.parquet(folder("readings"))
    plan = sensors_online(stored, ["sensor"], as_of=START)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan


def test_bucket_means(spark):
    df = spark.createDataFrame(
        [("a", 10.0, START), ("a", -1.0, START + MINUTE), ("a", None, START + 60 * MINUTE)],
        READINGS,
    )
    assert [tuple(r)[2:] for r in bucket_means(df, ["sensor"]).orderBy("bucket").collect()] == [
        (2, 1, 4.5, 10.0),
        (1, 0, None, None),
    ]


def rounded(df, *columns):
    return rows(df.withColumns({c: F.round(c, 9) for c in columns}))


def test_rollup_gives_what_the_readings_give(readings):
    keys = ["sensor"]
    totals = rollup(readings, keys).cache()
    means = ("average_measurement", "average_valid")
    assert rounded(total_metrics(totals), *means) == rounded(sensor_metrics(readings), *means)
    assert rounded(total_health(totals, keys), "average_valid") == rounded(
        health_counts(readings, keys), "average_valid"
    )
    assert rounded(total_means(totals, keys), *means) == rounded(bucket_means(readings, keys), *means)
    assert rows(total_last(totals, keys)) == rows(last_readings(readings, keys))


def plain_smooth(buckets, size):
    window = Window.partitionBy("sensor").orderBy("bucket").rowsBetween(1 - size, 0)
    valid = buckets.where(F.col("average_valid").isNotNull())
    return valid.withColumn("smoothed", F.avg("average_valid").over(window))


def test_largest_of_several_last_readings(spark):
    data = [("a", v, START) for v in (3.0, None, 9.0, 5.0)] + [
        ("a", 99.0, START - MINUTE), ("b", None, START), ("c", 7.0, None),
    ]
    df = spark.createDataFrame(data, READINGS).repartition(4)
    expected = [("a", START, 9.0), ("b", START, None), ("c", None, None)]
    assert rows(last_readings(df, ["sensor"], repeatable=True)) == expected
    assert rows(total_last(rollup(df, ["sensor"], repeatable=True), ["sensor"])) == expected
    assert rows(sensors_online(df, ["sensor"])) == expected[:2]


def test_repeatable_last_readings_agree_with_the_others(readings):
    keys = ["sensor"]
    plain = rows(last_readings(readings, keys))
    assert rows(last_readings(readings, keys, repeatable=True)) == plain
    assert rows(total_last(rollup(readings, keys, repeatable=True), keys)) == plain


@pytest.mark.parametrize("size", [1, 2, 5, 40])
@pytest.mark.parametrize("segment", ["day", "hour", "year"])
def test_smoothing_in_segments_equals_one_window(readings, size, segment):
    # Buckets of ten minutes leave gaps, and segments with fewer buckets than the window.
    buckets = bucket_means(readings, ["sensor"], "10 minutes").cache()
    found = smooth(buckets, ["sensor"], size, segment=segment)
    assert rounded(found, "smoothed") == rounded(plain_smooth(buckets, size), "smoothed")


def test_smoothing_keeps_null_keys_together(spark):
    data = [(None, float(i), START + i * 60 * MINUTE) for i in range(8)]
    buckets = bucket_means(spark.createDataFrame(data, READINGS), ["sensor"])
    found = smooth(buckets, ["sensor"], 3, segment="day").orderBy("bucket")
    assert [r.smoothed for r in found.collect()] == [0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
