"""Dashboards kept by change: tables by day, late batches, and what a batch writes."""

from __future__ import annotations

import datetime
import random
from pathlib import Path

import pytest
from helpers import rows
from pyspark.sql import functions as F

from lakeline.config import DocTarget, TableTarget
from lakeline.operators.dashboard import dashboard_tables
from lakeline.operators.rollup import rollup
from lakeline.sinks.days import DayStore, day_of, read_days, write_days
from lakeline.sinks.stores import read_version
from lakeline.streaming import start_dashboard
from lakeline.streaming.dashboard import BY_DAY, DashboardStore
from lakeline.streaming.jobs import DRAIN, run_to_end

T0 = datetime.datetime(2024, 9, 1)
READINGS = "sensor_id string, sensor_type string, measurement double, timestamp timestamp"
KEYS = ["sensor_id"]


def at(sensor, day, hour, value=90.0):
    return (sensor, "t", value, T0 + datetime.timedelta(days=day, hours=hour))


@pytest.fixture
def table(spark):
    return lambda *found: spark.createDataFrame(list(found), READINGS)


def shown(tables):
    means = [c for c in tables["sensor_smoothing"].columns if c != "average_measurement"]
    rounded = F.round("smoothed", 6).alias("smoothed")
    smoothed = tables["sensor_smoothing"].select(*[c for c in means if c != "smoothed"], rounded)
    return {
        **{n: rows(t.select(sorted(t.columns))) for n, t in tables.items() if n != "sensor_smoothing"},
        "sensor_smoothing": rows(smoothed.select(sorted(smoothed.columns))),
    }


# Days of a table


def test_days_are_replaced_by_their_newest_version(spark, table, folder):
    target = TableTarget.parquet_files(folder("days"))
    store = DayStore(spark, target)
    dated = [r.withColumn("day", day_of("timestamp")) for r in (
        table(at("a", 0, 1), at("a", 1, 1)), table(at("b", 1, 2)), table(("c", "t", 1.0, None)),
    )]
    assert store.read() is None and store.days() == {}
    for version, found in enumerate(dated):
        write_days(found, [target], version, [])
        write_days(found, [target], version, [])  # a repeat
    assert sorted(r.sensor_id for r in read_days(spark, target).collect()) == ["a", "b", "c"]
    assert store.days() == {"2024-09-01": 0, "2024-09-02": 1, "none": 2}
    assert store.days(before=1) == {"2024-09-01": 0, "2024-09-02": 0}
    second = read_days(spark, target, since=datetime.date(2024, 9, 2))
    assert rows(second.select("sensor_id")) == [("b",)] and len(second.inputFiles()) == 1


def test_a_version_counts_when_it_is_committed_and_readers_go_on(spark, table, folder):
    store = DayStore(spark, TableTarget.parquet_files(folder("days")))
    dated = table(at("a", 0, 1)).withColumn("day", day_of("timestamp"))
    store.write(dated, 0)
    assert store.read() is None
    store.commit(0)
    reader = store.read()
    store.write(dated.withColumn("sensor_id", F.lit("new")), 1)
    assert rows(store.read().select("sensor_id")) == [("a",)]
    store.commit(1)
    assert rows(reader.select("sensor_id")) == [("a",)]
    assert rows(store.read().select("sensor_id")) == [("new",)]


# The dashboard


def test_every_batch_leaves_the_tables_of_a_batch_job(spark, table, folder):
    draw = random.Random(4)
    hours = [(s, d, h) for s in "abc" for d in range(12) for h in range(24) if draw.random() < 0.1]
    # A sensor with gaps of days, one that begins late, one that is always invalid, one without times.
    batches = [[at(s, d, h, draw.choice([90.0, 30.0, -1.0])) for s, d, h in hours if d % 4 != 3 and d < 9]]
    batches.append([at("sparse", d, 0, float(80 + d)) for d in (0, 4, 9, 11)])
    batches.append([at(s, d, h) for s, d, h in hours if d >= 9] + [at("new", 11, 5), ("x", "t", 85.0, None)])
    batches.append([at("dead", d, 3, -1.0) for d in range(12)])
    batches.append([at("sparse", 2, 7, 100.0), at("a", 0, 23, 100.0)])  # late
    batches.append([at(s, d, h, 81.0) for s, d, h in hours if d % 4 == 3])  # late
    batches.append([("y", "t", 85.0, None)])
    store = DashboardStore(spark, folder("store"), KEYS, fold=3)
    arrived, smoothing = [], TableTarget.parquet_files(folder("smoothing"))
    for number, found in enumerate(batches):
        arrived += found
        for _ in range(2 if number in (1, 4) else 1):  # some batches are repeated
            days = store.add(table(*found), number, "1 hour")
            smoothed = store.smoothed(days)
            if smoothed is not None:
                write_days(smoothed, [smoothing], number, [])
        expected = dashboard_tables(rollup(table(*arrived), KEYS), KEYS)
        means = store.buckets()
        assert rows(means.where("bucket IS NOT NULL").select("sensor_id", "bucket", "n")) == rows(
            expected["sensor_buckets"].select("sensor_id", "bucket", "n")
        )
        own = dashboard_tables(store.sensors(), KEYS)
        for name in ("sensor_metrics", "sensor_health", "sensors_online"):
            names = [c for c in expected[name].columns if c not in ("last_measurement", "average_valid")]
            assert rows(own[name].select(names)) == rows(expected[name].select(names)), (number, name)
        got = read_days(spark, smoothing).select("sensor_id", "bucket", F.round("smoothed", 6))
        assert rows(got) == rows(
            expected["sensor_smoothing"].select("sensor_id", "bucket", F.round("smoothed", 6))
        ), number


def written_since(path, moment):
    files = [f for f in Path(path).rglob("*.parquet") if f.stat().st_mtime_ns > moment]
    return sum(f.stat().st_size for f in files)


def test_what_a_batch_writes_does_not_grow_with_the_history(spark, folder, tmp_path):
    lake, written, days = folder("lake"), [], 30
    targets = {name: [TableTarget.parquet_files(folder("out", name))] for name in BY_DAY}
    for day in range(days):
        found = [at(f"s{k}", day, h, 80.0 + k) for k in range(5) for h in range(24)]
        spark.createDataFrame(found, READINGS).coalesce(1).write.mode("append").parquet(lake)
        if day % 5 == 4:
            moment = max((f.stat().st_mtime_ns for f in tmp_path.rglob("*")), default=0)
            stream = spark.readStream.schema(READINGS).parquet(lake)
            run_to_end(start_dashboard(stream, targets, folder("checkpoint"), KEYS, DRAIN))
            written.append([written_since(folder("out", n), moment) for n in BY_DAY])
    for sizes in zip(*written, strict=True):
        assert max(sizes[2:]) < 1.5 * min(sizes[:2]), written
    assert read_days(spark, targets["sensor_buckets"][0]).count() == days * 24 * 5


def test_documents_and_tables_by_day(spark, table, folder):
    readings = table(at("a", 0, 1), at("a", 1, 1, 30.0))
    means = dashboard_tables(rollup(readings, KEYS), KEYS)["sensor_buckets"]
    documents = DocTarget.json_files(folder("docs"), means.schema)
    write_days(means.withColumn("day", day_of("bucket")), [documents], 0, KEYS)
    assert rows(read_days(spark, documents)) == rows(means)
    with pytest.raises(ValueError, match="holds no rows"):
        read_days(spark, TableTarget.parquet_files(folder("nothing")))
    empty = TableTarget("parquet", {"path": folder("nothing")}, means.schema)
    assert read_days(spark, empty).count() == 0
