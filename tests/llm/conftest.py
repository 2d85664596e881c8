from __future__ import annotations

import os
import random
from pathlib import Path

import duckdb
import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).is_dir():
        pytest.skip("test tables are not there")
    return SF_DIR


@pytest.fixture(scope="session")
def tables(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield connection
    connection.close()


@pytest.fixture(scope="session")
def texts(tables):
    found = tables.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    return dict(found)


@pytest.fixture
def documents(spark):
    """Rows of (id, text), with further columns whose names an operator may use itself."""

    def make(*rows):
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, "
            "node long, kept string, score string, digest string, piece string, seed string"
        )
        full = [(i, t, "en", None, len(t or ""), 1, "x", "y", None, "z", None) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def prose():
    """Text of so many words, different for each seed."""

    def make(seed, count, vocabulary=4000):
        draw = random.Random(seed)
        return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(count))

    return make
