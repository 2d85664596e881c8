"""Current tables from change messages, and runs merged in tiers."""

from __future__ import annotations

import datetime
import json

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.operators.current import (
    current_rows,
    decode_changes,
    fold_changes,
    forget_deletions,
    rows_at,
)
from lakeline.sinks.files import children, remove
from lakeline.streaming.runs import Run, RunStore

KEY = (T.StructField("id", T.LongType()),)


def message(op, position, key=None, value=None, moment=0, side="after", **source):
    row = None if key is None else {"id": key, "sensor_type": "t", "measurement": value, "timestamp": 0}
    before = row if op == "d" else None
    payload = {"op": op, "before": before, "after": None if op == "d" else row}
    return json.dumps({"payload": {**payload, "source": {"lsn": position, "ts_ms": moment, **source}}})


@pytest.fixture
def changes(lines):
    def make(*messages, **options):
        return decode_changes(lines(*messages), KEY, **options)

    return make


def test_the_last_change_wins_in_any_order(changes):
    log = [
        message("c", 1, 1, 10.0), message("u", 4, 1, 11.0), message("c", 2, 2, 20.0), message("d", 5, 2),
        message("c", 3, 3, 30.0), message("d", 6, 3), message("c", 7, 3, 31.0), message("r", 8, 4, None),
    ]
    expected = [(1, 11.0), (3, 31.0), (4, None)]
    for arriving in (log, log[::-1], [*log, *log[:5]], log[3:] + log[:3] + [None, "damaged"]):
        folded = fold_changes(changes(*arriving), ["id"])
        assert rows(current_rows(folded).select("id", "measurement")) == expected
    # Folding is merging: parts folded apart, and folded again, give the same.
    early, late = (fold_changes(changes(*part), ["id"]) for part in (log[5:], log[:6]))
    again = fold_changes(early.unionByName(late).unionByName(early), ["id"])
    assert rows(current_rows(again).select("id", "measurement")) == expected


def test_the_table_at_an_earlier_position(changes):
    log = changes(message("c", 1, 1, 1.0), message("d", 2, 1), message("c", 3, 1, 3.0))
    for position, expected in ((1, [(1, 1.0)]), (2, []), (3, [(1, 3.0)])):
        found = rows_at(log, ["id"], F.struct(F.lit(position).cast("long").alias("lsn")))
        assert rows(found.select("id", "measurement")) == expected


def test_messages_that_change_nothing_are_left_out(changes):
    found = changes(
        None, "damaged", "{}", message("c", None, 1, 1.0), message("c", 1, None), message(None, 2, 1, 1.0)
    )
    assert found.count() == 0
    assert fold_changes(found, ["id"]).count() == 0


def test_a_deletion_may_have_its_key_from_the_message(spark):
    pairs = [
        (json.dumps({"payload": {"id": 7}}), message("c", 1, 7, 1.0)),
        (json.dumps({"payload": {"id": 7}}), message("d", 2)),
        (json.dumps({"payload": {"id": 8}}), None),
    ]
    messages = spark.createDataFrame(pairs, "key string, value string")
    found = decode_changes(messages, KEY, message_key="key")
    assert rows(found.select("id", "deleted")) == [(7, False), (7, True)]
    assert current_rows(fold_changes(found, ["id"])).count() == 0


def test_changes_of_documents(lines):
    def document(op, moment, number, **fields):
        text = json.dumps(fields) if fields else None
        source = {"ts_ms": moment, "ord": number}
        image = {"after": text} if op != "d" else {"before": text}
        return json.dumps({"payload": {"op": op, **image, "source": source}})

    log = [
        document("c", 5, 1, id=1, sensor_type="a", measurement=1.5, timestamp="2024-01-02 03:04:05"),
        document("u", 5, 2, id=1, sensor_type="b", measurement=2.5, timestamp="2024-01-02 03:04:06"),
        document("c", 5, 3, id=2, sensor_type="a", measurement=1.0, timestamp=None),
        document("d", 6, 1, id=2),
    ]
    found = decode_changes(lines(*log), KEY, order=("ts_ms", "ord"), documents=True)
    [row] = current_rows(fold_changes(found, ["id"])).collect()
    assert (row.id, row.sensor_type, row.measurement) == (1, "b", 2.5)
    assert row.timestamp == datetime.datetime(2024, 1, 2, 3, 4, 6)


def test_old_deletions_are_forgotten(changes):
    day = 86_400_000
    folded = fold_changes(
        changes(message("d", 1, 1, moment=0), message("d", 2, 2, moment=2 * day), message("c", 3, 3, 1.0, 3 * day)),
        ["id"],
    )
    kept = forget_deletions(folded, datetime.timedelta(days=2))
    assert rows(kept.select("id")) == [(2,), (3,)]


@pytest.fixture
def store(spark, folder):
    def merge(found, oldest):
        return found.groupBy("key").agg(F.sum("n").alias("n"), F.max("oldest").alias("oldest")).withColumn(
            "oldest", F.col("oldest") | F.lit(oldest)
        )

    return RunStore(spark, folder("runs"), merge, fold=3)


def batch(spark, number):
    return spark.createDataFrame([(number % 2, number, False)], "key int, n long, oldest boolean")


def test_runs_are_merged_in_tiers(spark, store):
    assert store.rows() is None
    for number in range(10):
        store.add(batch(spark, number), number)
        expected = {k: sum(n for n in range(number + 1) if n % 2 == k) for k in range(min(number + 1, 2))}
        assert {r.key: r.n for r in store.rows().collect()} == expected
    assert store.runs() == [Run(2, 0, 8), Run(0, 9, 9)]


def test_repeats_and_half_written_runs_change_nothing(spark, store, folder):
    for number in (0, 1, 1, 2, 1, 3, 3):
        store.add(batch(spark, number), number)
    assert {r.key: r.n for r in store.rows().collect()} == {0: 2, 1: 4}
    batch(spark, 50).write.parquet(folder("runs", "run-1-3-5"))
    remove(spark, folder("runs", "run-1-3-5", "_SUCCESS"))
    assert "run-1-3-5" in children(spark, folder("runs"))
    assert {r.key: r.n for r in store.rows().collect()} == {0: 2, 1: 4}
