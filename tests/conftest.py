from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark import SparkConf, SparkContext

sys.path[:0] = [str(p) for p in Path(__file__).resolve().parents[:2]]

from lakeline.session import build_session  # noqa: E402


def _shared_folder(tmp_path_factory):
    """A checkpoint folder, unless the machine's settings name one: a running session cannot get it."""
    SparkContext._ensure_initialized()
    if SparkConf().contains("spark.checkpoint.dir"):
        return {}
    return {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "lakeline-tests",
        master=f"local[{os.environ.get('TEST_CPUS', '8')}]",
        settings={
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.maxMetadataStringLength": "2000",
            **_shared_folder(tmp_path_factory),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Rows of text from Python strings."""

    def make(*values):
        return spark.createDataFrame([(v,) for v in values], "value string")

    return make


@pytest.fixture
def folder(tmp_path):
    """A fresh folder's path as a string, made from parts."""

    def make(*parts):
        return str(tmp_path.joinpath(*parts))

    return make
