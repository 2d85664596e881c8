"""JSON files of every layout, cut at any place."""

from __future__ import annotations

import json
import random

import pytest
from helpers import rows
from pyspark.sql import types as T

from lakeline.sources.json_arrays import json_objects, read_json_objects, read_json_readings
from lakeline.sources.files import read_sensor_json

NESTED = "id long, text string, inner struct<a:long,list:array<struct<b:string>>>"


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    old = {}
    for name, value in {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}.items():
        old[name] = spark.conf.get(name)
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def objects(count, seed):
    """Objects with braces, quotes and backslashes in their strings, and objects within."""
    draw = random.Random(seed)
    signs = ["}", "{", '"', "\\", '\\"', "],[", "é", "x" * 90, "},{", '"}', "\n"]
    return [
        {
            "id": i,
            "text": "".join(draw.choice(signs) for _ in range(draw.randrange(9))),
            "inner": {"a": i, "list": [{"b": draw.choice(signs)} for _ in range(draw.randrange(3))]},
        }
        for i in range(count)
    ]


def written(found, layout):
    if layout == "array":
        return json.dumps(found)
    if layout == "compact":
        return json.dumps(found, separators=(",", ":"), ensure_ascii=False) + "\n"
    if layout == "indented":
        return json.dumps(found, indent=2)
    return "\n".join(map(json.dumps, found)) + "\n"


@pytest.mark.parametrize("layout", ["array", "compact", "indented", "lines"])
def test_every_layout_gives_its_objects(spark, tmp_path, small_splits, layout):
    expected = []
    for number in range(3):
        found = objects(60, number)
        expected += found
        (tmp_path / f"{number}.json").write_text(written(found, layout), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text("[]\n")
    got = json_objects(spark, str(tmp_path))
    assert sorted(json.dumps(json.loads(r.value)) for r in got.collect()) == sorted(map(json.dumps, expected))
    parsed = read_json_objects(spark, str(tmp_path), T.StructType.fromDDL(NESTED))
    assert parsed.where("_damaged IS NULL").count() == len(expected)
    # Each file is one line, or few, and yet read by many tasks.
    assert got.rdd.getNumPartitions() > 3 * 5


def test_an_object_longer_than_a_split(spark, tmp_path, small_splits):
    long = {"id": 1, "text": '{"}' * 900, "inner": None}
    (tmp_path / "a.json").write_text(json.dumps([{"id": 0}, long, {"id": 2}]))
    got = read_json_objects(spark, str(tmp_path), T.StructType.fromDDL(NESTED)).orderBy("id").collect()
    assert [r.id for r in got] == [0, 1, 2] and got[1].text == long["text"]


def test_text_that_is_no_object_is_damaged(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":1}, 7, {"id":"no number"}, {"id":2}] rest')
    (tmp_path / "b.json").write_text('{"id":3}\n{"id":4,"te')
    got = read_json_objects(spark, str(tmp_path), T.StructType.fromDDL(NESTED))
    assert rows(got.where("_damaged IS NULL").select("id")) == [(1,), (2,), (3,)]
    damaged = {r._damaged for r in got.where("_damaged IS NOT NULL").collect()}
    assert damaged == {"7", '{"id":"no number"}', "rest", '{"id":4,"te'}


def test_readings_are_those_of_the_plain_reader(spark, tmp_path):
    found = [
        {"sensor_type": f"t{i % 3}", "measurement": None if i % 5 == 0 else i / 2, "timestamp": "2024-09-01 10:00:03"}
        for i in range(50)
    ]
    (tmp_path / "a.json").write_text(json.dumps(found))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, found)))
    path = str(tmp_path)
    assert rows(read_json_readings(spark, path)) == rows(read_sensor_json(spark, path))
