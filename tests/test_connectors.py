"""Stores without a path: a table the session reads and writes through its own data source."""

from __future__ import annotations

from unittest import mock

import pytest
from helpers import rows

from lakeline.config import DocTarget, TableTarget
from lakeline.sinks import write_batch, write_metrics, write_table
from lakeline.sinks.stores import save
from lakeline.sources import read_jdbc, read_kafka, read_target


@pytest.fixture(scope="module")
def folder_table(spark):
    """A data source that appends to a directory and creates it, as a database does a table."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter

    class Reader(DataSourceReader):
        def __init__(self, directory):
            self.directory = directory

        def read(self, partition):
            import json
            import os

            for name in sorted(os.listdir(self.directory)):
                with open(os.path.join(self.directory, name)) as file:
                    yield from (tuple(json.loads(line)) for line in file)

    class Writer(DataSourceWriter):
        def __init__(self, directory):
            self.directory = directory

        def write(self, iterator):
            import json
            import os
            import uuid

            from pyspark.sql.datasource import WriterCommitMessage

            os.makedirs(self.directory, exist_ok=True)
            with open(os.path.join(self.directory, uuid.uuid4().hex), "w") as file:
                for row in iterator:
                    file.write(json.dumps([row["k"], row["n"], row["batch_id"]]) + "\n")
            return WriterCommitMessage()

    class FolderTable(DataSource):
        @classmethod
        def name(cls):
            return "foldertable"

        def schema(self):
            return "k string, n bigint, batch_id bigint"

        def reader(self, schema):
            return Reader(self.options["dir"])

        def writer(self, schema, overwrite):
            return Writer(self.options["dir"])

    spark.dataSource.register(FolderTable)
    return lambda directory: TableTarget("foldertable", {"dir": directory})


def test_batches_in_a_table_are_repeatable(spark, folder_table, folder):
    table = folder_table(folder("table"))
    batch = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, n bigint")
    write_batch(batch, table, 0, ["k"])
    write_batch(batch, table, 0, ["k"])
    expected = [(None, 2, 0), ("a", 1, 0), ("c", 3, 0)]
    assert rows(read_target(spark, table)) == expected
    # A writer lost half-way left part of batch 1.
    save(spark.createDataFrame([("a", 1, 1)], "k string, n bigint, batch_id bigint"), table)
    docs = DocTarget.json_files(folder("docs"))
    write_metrics(batch, [docs, table], 1, ["k"])
    assert rows(read_target(spark, table).where("batch_id = 1")) == [(None, 2, 1), ("a", 1, 1), ("c", 3, 1)]
    assert read_target(spark, docs).count() == 3


class Recorder:
    """Stands in for a reader or writer and remembers what it was told."""

    def __init__(self, result=None):
        self.told, self.result = {}, result

    def format(self, name):
        self.told["format"] = name
        return self

    def options(self, **options):
        self.told.update(options)
        return self

    def mode(self, mode):
        self.told["mode"] = mode
        return self

    def load(self):
        return self.result

    def save(self):
        return None


def test_table_bounds_are_asked_for_first():
    bounds = Recorder(mock.Mock(head=lambda: (5, 95)))
    table = Recorder("the table")
    session = mock.Mock()
    type(session).read = mock.PropertyMock(side_effect=[bounds, table])
    found = read_jdbc(session, "jdbc:x", "t", partition_col="id", n=9, user="u")
    assert found == "the table"
    assert bounds.told["dbtable"] == "(select min(id) lo, max(id) hi from t) bounds"
    assert "partitionColumn" not in bounds.told
    split = {k: table.told[k] for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    assert split == {"partitionColumn": "id", "lowerBound": "5", "upperBound": "95", "numPartitions": "9"}


def test_empty_table_is_read_without_a_split():
    session = mock.Mock()
    table = Recorder("empty")
    type(session).read = mock.PropertyMock(
        side_effect=[Recorder(mock.Mock(head=lambda: (None, None))), table]
    )
    assert read_jdbc(session, "jdbc:x", "t", partition_col="id", n=9) == "empty"
    assert table.told == {"format": "jdbc", "url": "jdbc:x", "dbtable": "t"}


def test_table_write_options():
    writer = Recorder()
    write_table(mock.Mock(write=writer), "jdbc:x", "t", user="u")
    assert writer.told == {
        "format": "jdbc", "url": "jdbc:x", "dbtable": "t", "user": "u", "mode": "append",
    }


def test_snapshot_of_a_table_keeps_its_definition():
    writer = Recorder()
    frame = mock.Mock()
    frame.persist.return_value = mock.Mock(write=writer)
    write_metrics(frame, [TableTarget.jdbc("jdbc:x", "t")])
    assert writer.told["truncate"] == "true" and writer.told["mode"] == "overwrite"
    frame.persist.return_value.unpersist.assert_called_once()


def test_topic_is_read_from_the_start():
    reader = Recorder("stream")
    assert read_kafka(mock.Mock(readStream=reader), "b:1", "t") == "stream"
    assert reader.told == {
        "format": "kafka", "kafka.bootstrap.servers": "b:1", "subscribe": "t",
        "startingOffsets": "earliest",
    }
