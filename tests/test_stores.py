"""Lake files, stores, migrations and metrics saved twice."""

from __future__ import annotations

import datetime
import os
import time
from pathlib import Path

import pytest
from helpers import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lakeline.config import DocTarget, TableTarget
from lakeline.operators.dashboard import TABLES
from lakeline.operators.rollup import rollup
from lakeline.operators.sensors import class_counts, sensor_health, sensor_metrics, sensors_online
from lakeline.plans.sensor_lake import lake_metrics, refresh, start_lake_updates
from lakeline.schemas import lake_schema
from lakeline.sinks import (
    migrate,
    read_version,
    save,
    write_batch,
    write_docs,
    write_lake_csv,
    write_lake_json,
    write_metrics,
    write_version,
)
from lakeline.sinks.files import children
from lakeline.sinks.stores import accepted_mode, missing_rows
from lakeline.sources import (
    read_docs,
    read_lake_rejects,
    read_sensor_csv,
    read_sensor_json,
    read_sensor_lake,
    read_target,
)
from lakeline.sinks.days import read_days
from lakeline.sources.stores import split_options
from lakeline.streaming.dashboard import BY_DAY

T0 = datetime.datetime(2024, 9, 1, 10)


@pytest.fixture
def lake(tmp_path):
    """Files as other programs leave them: whole numbers here, decimals there, one JSON array."""
    path = tmp_path / "lake"
    path.mkdir()
    (path / "a.csv").write_text("sensor_type,measurement,timestamp\nt,85,2024-09-01 10:00:00\n")
    (path / "b.csv").write_text(
        "sensor_type,measurement,timestamp\nt,-1.0,2024-09-01 10:00:01\nt,,2024-09-01 10:00:02\n"
    )
    (path / "c.json").write_text(
        '[{"sensor_type":"t","measurement":85,"timestamp":"2024-09-01 10:00:03"},'
        '{"sensor_type":"t","measurement":null,"timestamp":"2024-09-01 10:00:04"}]'
    )
    (path / "notes.txt").write_text("not a reading\n")
    return str(path)


def test_lake_reads_both_formats(spark, lake):
    readings = read_sensor_lake(spark, lake)
    assert [r.timestamp.second for r in readings.orderBy("timestamp").collect()] == [0, 1, 2, 3, 4]
    assert rows(class_counts(readings)) == [("invalid", 3), ("normal", 2)]
    assert read_sensor_csv(spark, lake).count() == 3


def test_json_array_on_one_line_gives_rows(spark, lake):
    assert rows(read_sensor_json(spark, lake)) == [
        ("t", None, T0.replace(second=4)),
        ("t", 85.0, T0.replace(second=3)),
    ]


def test_lake_without_one_of_the_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sensor_type,measurement,timestamp\nt,85,2024-09-01 10:00:00\n")
    assert read_sensor_lake(spark, str(tmp_path)).count() == 1


def test_lake_csv_with_other_columns_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,measurement,sensor_type\n2024-09-01 10:00:00,85,t\n")
    with pytest.raises(Exception, match="header"):
        read_sensor_csv(spark, str(tmp_path)).collect()


def test_lake_times_of_any_precision(spark, tmp_path):
    times = ["2024-09-01 10:00:00", "2024-09-01T10:00:00.5", "2024-09-01 10:00:00.123456"]
    (tmp_path / "a.csv").write_text(
        "sensor_type,measurement,timestamp\n" + "".join(f"t,1,{t}\n" for t in times)
    )
    (tmp_path / "a.json").write_text(
        "".join(f'{{"sensor_type":"t","timestamp":"{t}"}}\n' for t in times)
    )
    micros = [0, 123456, 500000]
    for reader in (read_sensor_csv, read_sensor_json):
        assert sorted(r.timestamp.microsecond for r in reader(spark, str(tmp_path)).collect()) == micros


@pytest.fixture
def readings(spark):
    return spark.createDataFrame(
        [("t", 85.5, T0), ("t", None, T0.replace(microsecond=1)), (None, -1.0, None)],
        "sensor_type string, measurement double, timestamp timestamp",
    )


def test_lake_files_round_trip_and_add_up(spark, readings, folder):
    for write, read in ((write_lake_csv, read_sensor_csv), (write_lake_json, read_sensor_json)):
        path = folder(write.__name__)
        write(readings, path)
        assert rows(read(spark, path)) == rows(readings)
        write(readings, path)
        assert read(spark, path).count() == 6


def test_documents_are_not_overwritten_unasked(spark, readings, folder):
    target = DocTarget.json_files(folder("docs"), readings.schema)
    write_docs(readings, target)
    assert rows(read_docs(spark, target)) == rows(readings)
    with pytest.raises(AnalysisException):
        write_docs(readings, target)
    write_docs(readings, target, "append")
    assert read_docs(spark, target).count() == 6


def test_migration_both_ways(spark, readings, folder):
    table = TableTarget.parquet_files(folder("table"))
    docs = DocTarget.json_files(folder("docs"), readings.schema)
    back = TableTarget.parquet_files(folder("back"))
    save(readings, table)
    migrate(spark, table, docs)
    migrate(spark, docs, back)
    assert rows(read_target(spark, back)) == rows(readings)


def test_snapshot_in_both_stores_is_replaced(spark, readings, folder):
    metrics = sensor_metrics(readings)
    targets = [
        DocTarget.json_files(folder("docs"), metrics.schema),
        TableTarget.parquet_files(folder("table")),
    ]
    for _ in range(2):
        write_metrics(metrics, targets)
    for target in targets:
        assert rows(read_target(spark, target)) == [(42.25, 2, 85.5)]


def test_repeated_batch_adds_nothing(spark, readings, folder):
    targets = [DocTarget.json_files(folder("docs")), TableTarget.parquet_files(folder("table"))]
    counts = class_counts(readings)
    for batch in (0, 1, 1, 0):
        write_metrics(counts, targets, batch, ["class"])
    for target in targets:
        saved = read_target(spark, target)
        assert rows(saved.select("batch_id", "class", "n")) == [
            (0, "invalid", 2),
            (0, "normal", 1),
            (1, "invalid", 2),
            (1, "normal", 1),
        ]
    # One store may have got the batch before the other failed.
    write_batch(counts, targets[0], 2, ["class"])
    write_metrics(counts, targets, 2, ["class"])
    assert [read_target(spark, t).count() for t in targets] == [6, 6]


def test_only_missing_rows_of_a_batch_are_added(spark):
    new = spark.createDataFrame([(1, "a", 5), (1, None, 6), (1, "c", 7)], "batch_id int, k string, n int")
    stored = new.where("n < 7").withColumn("n", F.col("n") * 10)
    assert rows(missing_rows(new, stored, ("batch_id", "k"))) == [(1, "c", 7)]


def test_dashboard_from_the_lake(spark, lake, folder):
    metrics = lake_metrics(spark, lake, staging=folder("rollup"))
    assert set(metrics) == {
        "sensor_metrics", "sensor_health", "sensor_buckets", "sensor_smoothing", "sensors_online",
    }
    stores = {
        name: [DocTarget.json_files(folder("docs", name)), TableTarget.parquet_files(folder("t", name))]
        for name in metrics
    }
    for _ in range(2):
        refresh(metrics, stores)
    tables = {name: read_target(spark, targets[1]) for name, targets in stores.items()}
    assert rows(tables["sensor_metrics"])[0][1:] == (3, 85.0)
    health = tables["sensor_health"].first()
    assert (health.n, health.n_normal, health.n_invalid, health.status) == (5, 2, 3, "faulty")
    assert rows(tables["sensors_online"]) == [("t", T0.replace(second=4), None)]
    assert tables["sensor_smoothing"].count() == 1


HEADER = "sensor_type,measurement,timestamp\n"


def test_lake_updates_read_new_files_only_however_old(spark, lake, folder):
    base = TableTarget.parquet_files(folder("tables"))
    targets = {name: [base.named(name)] for name in TABLES}

    def update():
        query = start_lake_updates(spark, lake, targets, folder("checkpoint"), fold=2)
        query.awaitTermination()
        read = sum(p.numInputRows for p in query.recentProgress)
        reads = {name: read_days if name in BY_DAY else read_version for name in targets}
        tables = {name: reads[name](spark, stores[0]) for name, stores in targets.items()}
        return read, rows(tables["sensor_metrics"])[0], tables

    mean = (85.0 - 1.0 + 85.0) / 3
    assert update()[:2] == (5, (mean, 3, 85.0))
    assert update()[:2] == (0, (mean, 3, 85.0))
    (Path(lake) / "d.csv").write_text(HEADER + "t,95,2024-09-01 10:00:05\n")
    os.utime(Path(lake) / "d.csv", (time.time() - 9 * 86400,) * 2)
    assert update()[:2] == (1, (66.0, 3, pytest.approx(265.0 / 3)))
    (Path(lake) / "e.csv").write_text(HEADER + "t,85,2024-09-01 12:00:00\nu,85,2024-09-01 12:00:01\n")
    read, _, tables = update()
    assert read == 2
    batch = lake_metrics(spark, lake)
    for name in TABLES:
        assert rows(tables[name]) == rows(batch[name])
    assert sorted(children(spark, folder("checkpoint", "rollups"))) == ["arrived", "buckets", "sensors"]


def test_tables_as_of_a_moment_know_nothing_later(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        HEADER
        + "a,90,2024-09-01 10:00:00\na,91,2024-09-01 10:20:00\n"
        + "b,92,2024-09-01 05:00:00\nb,93,2024-09-02 10:00:00\n"
    )
    as_of = T0.replace(minute=10)
    tables = lake_metrics(spark, str(tmp_path), as_of=as_of)
    assert rows(tables["sensors_online"]) == [("a", T0, 90.0)]
    health = {r.sensor_type: (r.n, r.status) for r in tables["sensor_health"].collect()}
    assert health == {"a": (1, "ok"), "b": (1, "offline")}
    readings = read_sensor_lake(spark, str(tmp_path))
    assert rows(sensors_online(readings, ["sensor_type"], as_of)) == [("a", T0, 90.0)]
    direct = sensor_health(readings, ["sensor_type"], as_of)
    assert {r.sensor_type: (r.n, r.status) for r in direct.collect()} == health


def test_damaged_lines_are_rejects_not_readings(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "t,9O.0,2024-09-01 10:00:00\nt,,2024-09-01 10:00:01\nt,5\n")
    (tmp_path / "b.json").write_text('{"sensor_type":"t","measurement":85,"timest\n{"sensor_type":"t"}\n')
    readings = read_sensor_lake(spark, str(tmp_path))
    assert readings.count() == 2 and readings.select("sensor_type").count() == 2
    assert rows(class_counts(readings)) == [("invalid", 2)]
    rejects = [r.value for r in read_lake_rejects(spark, str(tmp_path)).collect()]
    assert sorted(rejects) == ["t,5", "t,9O.0,2024-09-01 10:00:00", '{"sensor_type":"t","measurement":85,"timest']


def test_lake_files_with_a_key_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sensor_id," + HEADER + "s1,t,85,2024-09-01 10:00:00\ns2,t,,2024-09-01 10:00:00\n")
    keys = ["sensor_id", "sensor_type"]
    health = lake_metrics(spark, str(tmp_path), keys, schema=lake_schema(keys))["sensor_health"]
    assert rows(health.select("sensor_id", "status")) == [("s1", "ok"), ("s2", "faulty")]


def test_a_new_version_replaces_the_older_ones_when_it_is_whole(spark, readings, folder):
    target = TableTarget.parquet_files(folder("t"))
    for version in (0, 1, 1):
        write_version(readings.where(F.lit(version == 1)), [target], version)
    assert read_version(spark, target).count() == 3
    readings.write.parquet(folder("t", "version=7"))
    os.remove(folder("t", "version=7", "_SUCCESS"))
    assert children(spark, folder("t")) and read_version(spark, target).count() == 3


def test_modes_a_connector_accepts():
    mongo, files = DocTarget.mongo("mongodb://x/", "d", "c"), DocTarget.json_files("/x")
    assert accepted_mode(mongo, "errorifexists", False) == "append"
    assert accepted_mode(mongo, "overwrite", True) == "overwrite"
    assert accepted_mode(files, "errorifexists", True) == "errorifexists"
    with pytest.raises(ValueError, match="holds"):
        accepted_mode(mongo, "errorifexists", True)


def test_tables_are_copied_in_parts():
    options = {"url": "jdbc:x", "dbtable": "t"}
    parts = {**options, "partitionColumn": "id", "numPartitions": "8"}
    assert split_options(parts) == parts
    assert split_options({**options, "numPartitions": "1"}) == options
    for unsplit in (options, {**options, "numPartitions": "8"}, {**options, "partitionColumn": "id"}):
        with pytest.raises(ValueError, match="numPartitions"):
            split_options(unsplit)
