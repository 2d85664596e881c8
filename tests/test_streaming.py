"""Streams give what a batch over the same data gives, whatever the micro-batches."""

from __future__ import annotations

import datetime
import json
import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from lakeline.config import DocTarget, TableTarget
from lakeline.operators.cdc import decode_envelopes
from lakeline.operators.sensors import (
    bucket_means,
    health_counts,
    last_readings,
    online_at,
    sensor_metrics,
)
from lakeline.operators.smoothing import smooth
from lakeline.schemas import MESSAGE
from lakeline.sinks import read_version
from lakeline.sources import read_envelope_files, read_target
from lakeline.streaming import (
    latest_state,
    run_to_end,
    start_json_sink,
    start_keyed_state,
    start_running_metrics,
    windowed_means,
)
from lakeline.streaming.jobs import DRAIN

T0 = datetime.datetime(2024, 9, 1, 10)
ONE_FILE = {"maxFilesPerTrigger": "1"}


class Topic:
    """A directory of message files; each ``send`` adds one, later than those before."""

    def __init__(self, path):
        self.path = path
        self.sent = 0
        path.mkdir()

    def send(self, *messages):
        file = self.path / f"{self.sent:03d}.json"
        file.write_text("".join(json.dumps({"value": m}) + "\n" for m in messages))
        os.utime(file, (1_700_000_000 + self.sent * 10,) * 2)
        self.sent += 1


def reading(measurement, minute, sensor="t", op="c"):
    micros = round((T0 + datetime.timedelta(minutes=minute)).replace(
        tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    after = {"sensor_type": sensor, "measurement": measurement, "timestamp": micros}
    return json.dumps({"payload": {"op": op, "after": None if op == "d" else after}})


@pytest.fixture
def topic(tmp_path):
    return Topic(tmp_path / "topic")


def decoded(spark, topic):
    return decode_envelopes(read_envelope_files(spark, str(topic.path), **ONE_FILE))


def decoded_batch(spark, topic):
    return decode_envelopes(spark.read.schema(MESSAGE).json(str(topic.path)))


def fill(topic):
    topic.send(reading(85.0, 0), reading(-1.0, 1), None, "garbage")
    topic.send(reading(None, 70, "u"), reading(95.0, 75, "u"))
    topic.send(reading(None, 76, op="d"))
    topic.send(reading(40.0, 140), reading(90.0, 141, "u"), reading(88.0, 200, "u"))


def test_running_metrics_in_both_stores(spark, topic, folder):
    fill(topic)
    docs, table = DocTarget.json_files(folder("docs")), TableTarget.parquet_files(folder("table"))
    run_to_end(
        start_running_metrics(decoded(spark, topic), [docs, table], folder("checkpoint"), DRAIN)
    )
    saved = read_target(spark, table)
    assert rows(saved.select("batch_id", "count_invalid_measurements")) == [
        (0, 3), (1, 4), (2, 5), (3, 5),
    ]
    last = saved.where("batch_id = 3").drop("batch_id")
    assert rows(last) == rows(sensor_metrics(decoded_batch(spark, topic)))
    assert rows(read_target(spark, docs).select(saved.columns)) == rows(saved)


def test_restart_goes_on_from_the_checkpoint(spark, topic, folder):
    table = TableTarget.parquet_files(folder("table"))

    def drain():
        run_to_end(
            start_running_metrics(
                decoded(spark, topic), [table], folder("checkpoint"), DRAIN, history=False
            )
        )
        return rows(read_version(spark, table))

    totals = []
    for sent in ([reading(-1.0, 0)], [reading(80.0, 200)], [reading(-1.0, 1)], []):
        if sent:
            topic.send(*sent)
        totals.append(drain()[0][1])
    # The third reading is hours late, yet counts: no watermark applies here.
    assert totals == [1, 1, 2, 2]
    assert drain() == rows(sensor_metrics(decoded_batch(spark, topic)))


def test_replay_under_a_new_checkpoint_leaves_the_same_rows(spark, topic, folder):
    fill(topic)
    targets = [DocTarget.json_files(folder("docs")), TableTarget.parquet_files(folder("table"))]

    def replay(name):
        run_to_end(start_running_metrics(decoded(spark, topic), targets, folder(name), DRAIN))
        return [rows(read_target(spark, t).select("batch_id", "average_measurement")) for t in targets]

    assert replay("first") == replay("second")


def test_json_sink_holds_every_row_once(spark, topic, folder):
    fill(topic)
    stream = decoded(spark, topic)
    for _ in range(2):
        run_to_end(start_json_sink(stream, folder("out"), folder("checkpoint"), DRAIN))
    saved = spark.read.schema(stream.schema).json(folder("out"))
    assert rows(saved) == rows(decoded_batch(spark, topic))


def closed(spark, topic, folder):
    means = windowed_means(decoded(spark, topic), ["sensor_type"])
    run_to_end(start_json_sink(means, folder("out"), folder("checkpoint"), DRAIN))
    return spark.read.schema(means.schema).json(folder("out"))


def test_closed_buckets_equal_the_batch(spark, topic, folder):
    fill(topic)
    batch = bucket_means(decoded_batch(spark, topic), ["sensor_type"])
    # The newest reading is at 13:20, so buckets that end by 13:10 are closed.
    expected = rows(batch.where(F.col("bucket") < T0.replace(hour=13)))
    found = closed(spark, topic, folder)
    assert rows(found) == expected and len(expected) == 4
    assert rows(smooth(found, ["sensor_type"])) == rows(
        smooth(batch.where(F.col("bucket") < T0.replace(hour=13)), ["sensor_type"])
    )


def test_reading_behind_the_watermark_is_dropped(spark, topic, folder):
    topic.send(reading(80.0, 0), reading(90.0, 75))
    topic.send(reading(90.0, 76))
    topic.send(reading(84.0, 5), reading(92.0, 200))  # the first bucket closed at 11:10
    found = closed(spark, topic, folder).orderBy("bucket")
    assert [(r.n, r.average_measurement) for r in found.collect()] == [(1, 80.0), (2, 90.0)]


def test_state_updates_hold_only_what_changed(spark, topic, folder):
    fill(topic)
    table = TableTarget.parquet_files(folder("table"))
    keys = ["sensor_type"]
    readings = decoded(spark, topic).where("has_row")
    run_to_end(
        start_keyed_state(
            last_readings(readings, keys), keys, [table], folder("checkpoint"), DRAIN
        )
    )
    saved = read_target(spark, table)
    assert rows(saved.select("batch_id", "sensor_type")) == [(0, "t"), (1, "u"), (3, "t"), (3, "u")]
    state = latest_state(saved, keys)
    expected = last_readings(decoded_batch(spark, topic).where("has_row"), keys)
    assert rows(state) == rows(expected)
    as_of = T0.replace(hour=13, minute=20)
    assert [r.sensor_type for r in online_at(state, as_of, datetime.timedelta(minutes=59)).collect()] == ["u"]


@pytest.mark.parametrize("history", [True, False])
def test_health_on_a_stream(spark, topic, folder, history):
    fill(topic)
    table = TableTarget.parquet_files(folder("table"))
    keys = ["sensor_type"]
    counts = health_counts(decoded(spark, topic).where("has_row"), keys)
    run_to_end(
        start_keyed_state(counts, keys, [table], folder("checkpoint"), DRAIN, history=history)
    )
    expected = health_counts(decoded_batch(spark, topic).where("has_row"), keys)
    if history:
        state = latest_state(read_target(spark, table), keys)
    else:
        state = read_version(spark, table)
    assert rows(state.select(expected.columns)) == rows(expected)


def test_failure_in_a_sink_is_raised(spark, topic, folder):
    topic.send(reading(80.0, 0))
    broken = TableTarget("no-such-format", {"path": folder("x")})
    query = start_running_metrics(decoded(spark, topic), [broken], folder("checkpoint"), DRAIN)
    with pytest.raises(Exception, match="no-such-format"):
        run_to_end(query)
