"""Configuration files and store targets."""

from __future__ import annotations

import json
from unittest import mock

import pytest

from lakeline.config import DocTarget, JobConfig, TableTarget
from lakeline.session import scratch_path
from lakeline.sinks.stores import upserting
from lakeline.sources import jdbc_options, kafka_options

WHOLE = {
    "url": "mongodb://example.invalid/",
    "database": "d",
    "collection": "c",
    "delimiter": ",",
    "header": False,
    "inferSchema": False,
    "arquivo_entrada": "in.csv",
}


def test_missing_file_gives_the_defaults(tmp_path):
    assert JobConfig.load(str(tmp_path / "none.yaml")) == JobConfig()
    mine = JobConfig(url="u", input_path="p")
    assert JobConfig.load(str(tmp_path / "none.yaml"), mine) is mine


def test_whole_file_replaces_the_defaults(tmp_path):
    file = tmp_path / "config.json"
    file.write_text(json.dumps(WHOLE))
    config = JobConfig.load(str(file), JobConfig(database="other"))
    assert config == JobConfig(WHOLE["url"], "d", "c", ",", False, False, "in.csv")
    assert config.csv().delimiter == "," and not config.csv().header


def test_yaml_file(tmp_path):
    pytest.importorskip("yaml")
    file = tmp_path / "config.yaml"
    lines = [f"{key}: {value}" for key, value in WHOLE.items() if key != "delimiter"]
    file.write_text("\n".join([*lines, "delimiter: ;"]))
    assert JobConfig.load(str(file)).delimiter == ";"


def test_partial_or_strange_file_is_an_error(tmp_path):
    file = tmp_path / "config.json"
    file.write_text(json.dumps({k: v for k, v in WHOLE.items() if k != "header"}))
    with pytest.raises(ValueError, match="header"):
        JobConfig.load(str(file))
    file.write_text(json.dumps({**WHOLE, "extra": 1}))
    with pytest.raises(ValueError, match="extra"):
        JobConfig.load(str(file))
    file.write_text("[]")
    with pytest.raises(ValueError, match="mapping"):
        JobConfig.load(str(file))


def test_documents_need_an_address():
    with pytest.raises(ValueError, match="url"):
        JobConfig().documents()
    target = JobConfig(url="mongodb://example.invalid/").documents("sexo")
    assert target.format == "mongodb" and target.options["collection"] == "sexo"


def test_secrets_are_not_shown():
    table = TableTarget.jdbc("jdbc:x", "t", user="u", password="hidden")
    assert "hidden" not in repr(table)
    assert "hidden" not in repr(JobConfig(url="mongodb://u:hidden@example.invalid/"))


def test_kafka_options():
    assert kafka_options("broker.invalid:9092", "sensors") == {
        "kafka.bootstrap.servers": "broker.invalid:9092",
        "subscribe": "sensors",
        "startingOffsets": "earliest",
    }
    more = kafka_options("b", "t", "latest", maxOffsetsPerTrigger="1000", minPartitions="64")
    assert more["startingOffsets"] == "latest" and more["minPartitions"] == "64"


def test_jdbc_options():
    assert jdbc_options("jdbc:x", "t", user="u") == {"url": "jdbc:x", "dbtable": "t", "user": "u"}
    split = jdbc_options("jdbc:x", "t", "id", 0, 99, 8)
    assert {k: split[k] for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")} == {
        "partitionColumn": "id",
        "lowerBound": "0",
        "upperBound": "99",
        "numPartitions": "8",
    }
    with pytest.raises(ValueError, match="together"):
        jdbc_options("jdbc:x", "t", "id", 0, 99)


def test_document_store_upserts_by_batch_and_keys():
    target = DocTarget.mongo("mongodb://example.invalid/", "d", "c")
    options = upserting(target, ["sensor_id"]).options
    assert options["operationType"] == "replace"
    assert options["idFieldList"] == "batch_id,sensor_id"


def test_scratch_lies_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(base) and first != second


def test_a_cluster_must_name_its_shared_folder():
    def session(master):
        stand_in = mock.Mock()
        stand_in.conf.get.return_value = None
        stand_in.sparkContext.master = master
        return stand_in

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(session("spark://example.invalid:7077"), "x")
    assert "lakeline-" in scratch_path(session("local[2]"), "x")
