"""Small lake files gathered into few, without a change of what the lake holds."""

from __future__ import annotations

import json

import pytest
from helpers import rows

from lakeline.plans.compaction import CompactedLake
from lakeline.sinks.files import children, remove
from lakeline.sources import read_lake_rejects, read_sensor_lake


@pytest.fixture
def lake(tmp_path):
    def add(first, count):
        for i in range(first, first + count):
            reading = {"sensor_type": f"t{i % 3}", "measurement": i / 2, "timestamp": "2024-09-01 10:00:03"}
            if i % 2:
                lines = [",".join(reading), ",".join(map(str, reading.values()))]
                (tmp_path / f"lake/{i}.csv").write_text("\n".join(lines) + "\n")
            else:
                text = json.dumps(reading) if i % 10 else '{"sensor_type":"t0","measure'
                (tmp_path / f"lake/{i}.json").write_text(text + "\n")

    (tmp_path / "lake").mkdir()
    return add


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "lake"), str(tmp_path / "runs")


def same(spark, compacted, path):
    assert rows(compacted.read()) == rows(read_sensor_lake(spark, path))
    assert rows(compacted.rejects()) == rows(read_lake_rejects(spark, path))


def test_two_thousand_files_are_read_in_few_tasks(spark, lake, paths):
    lake(0, 2000)
    compacted = CompactedLake(spark, *paths, target_bytes=1 << 20)
    same(spark, compacted, paths[0])  # before any run
    assert compacted.compact() == 2000
    files = [n for n in children(spark, f"{paths[1]}/run-0-0-0") if n.endswith(".parquet")]
    # Two kinds, a thousand files of each to a task at the most.
    assert len(files) <= 4
    assert compacted.read().rdd.getNumPartitions() <= 8
    same(spark, compacted, paths[0])
    assert compacted.compact() == 0


def test_runs_take_only_new_files_and_are_merged(spark, lake, paths):
    compacted = CompactedLake(spark, *paths, fold=2)
    for part in range(5):
        lake(part * 10, 10)
        same(spark, compacted, paths[0])
        assert compacted.compact() == 10
        same(spark, compacted, paths[0])
    assert compacted.manifest().count() == 50
    assert [r.name for r in compacted._runs.runs()] == ["run-2-0-3", "run-0-4-4"]


def test_a_reader_is_not_disturbed_by_the_next_run(spark, lake, paths):
    compacted = CompactedLake(spark, *paths, fold=2)
    lake(0, 10)
    compacted.compact()
    reader = compacted.read()
    expected = rows(read_sensor_lake(spark, paths[0]))
    lake(10, 10)
    compacted.compact()  # merges the run that the reader has in its plan
    assert rows(reader) == expected


def test_a_run_that_broke_does_not_count(spark, lake, paths):
    compacted = CompactedLake(spark, *paths)
    lake(0, 10)
    compacted.compact()
    lake(10, 10)
    compacted.compact()
    remove(spark, f"{paths[1]}/run-0-1-1/_SUCCESS")  # its manifest and rows are there
    same(spark, compacted, paths[0])
    lake(20, 5)
    assert compacted.compact() == 15
    same(spark, compacted, paths[0])


def test_a_gathered_file_that_changed_stops_the_job(spark, lake, paths, tmp_path):
    compacted = CompactedLake(spark, *paths)
    lake(0, 4)
    compacted.compact()
    (tmp_path / "lake/2.json").write_text('{"sensor_type":"other"}\n')
    with pytest.raises(ValueError, match="changed after"):
        compacted.compact()


def test_an_empty_lake_and_settings_left_alone(spark, lake, paths):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    compacted = CompactedLake(spark, *paths, target_bytes=1 << 20)
    assert compacted.compact() == 0 and rows(compacted.read()) == []
    lake(0, 1)
    compacted.compact()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
