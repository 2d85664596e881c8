"""Change envelopes: rows, deletes, tombstones, garbage and times."""

from __future__ import annotations

import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from lakeline.functions.times import micros_to_timestamp, wall_clock_to_micros
from lakeline.operators.cdc import changed_rows, decode_document_envelopes, decode_envelopes
from lakeline.operators.sensors import sensor_metrics


def change(op, measurement, second):
    after = (
        "null"
        if op == "d"
        else f'{{"sensor_type":"t","measurement":{measurement},"timestamp":17251848{second:02d}000000}}'
    )
    return f'{{"payload":{{"op":"{op}","after":{after}}}}}'


CHANGES = (
    change("c", "85.0", 0),
    change("c", "-1.0", 1),
    change("c", "null", 2),
    change("r", "90.0", 3),
    change("d", None, 4),
    None,
    "garbage",
)


def test_every_message_gives_a_row(lines):
    decoded = decode_envelopes(lines(*CHANGES))
    assert decoded.count() == 7
    metrics = sensor_metrics(decoded).first()
    assert (metrics.average_measurement, metrics.count_invalid_measurements) == (58.0, 5)
    assert metrics.average_valid == 87.5
    assert changed_rows(decoded).count() == 4
    assert rows(decoded.groupBy("op", "has_row").count()) == [
        (None, False, 2),
        ("c", True, 3),
        ("d", False, 1),
        ("r", True, 1),
    ]


def test_binary_messages(lines):
    binary = lines(*CHANGES).select(F.col("value").cast("binary"))
    assert rows(decode_envelopes(binary)) == rows(decode_envelopes(lines(*CHANGES)))


def test_measurement_narrows_unless_asked(lines):
    message = lines(change("c", "0.1", 0))
    narrow, wide = decode_envelopes(message), decode_envelopes(message, measurement_type="double")
    assert narrow.first().measurement != 0.1
    assert wide.first().measurement == 0.1


def test_string_documents_decode(lines):
    document = '{\\"sensor_type\\":\\"t\\",\\"measurement\\":85,\\"timestamp\\":\\"2024-09-01 10:00:00\\"}'
    messages = lines(
        f'{{"payload":{{"op":"c","after":"{document}"}}}}',
        '{"payload":{"op":"d","after":null}}',
        None,
        "garbage",
        '{"payload":{"op":"c","after":"damaged {"}}',
        '{"payload":{"op":"c","after":"{\\"sensor_type\\":\\"t\\",\\"measurement\\":\\"9O\\"}"}}',
    )
    found = rows(decode_document_envelopes(messages))
    assert found[-1] == ("t", 85.0, datetime.datetime(2024, 9, 1, 10), "c", True)
    assert [r[4] for r in found[:5]] == [False] * 5
    assert all(r[:3] == (None, None, None) for r in found[:5])
    # A row image expected where a string stands gives no row, and the other way about.
    assert changed_rows(decode_envelopes(messages)).count() == 0


@pytest.fixture
def in_zone(spark):
    def use(zone):
        spark.conf.set("spark.sql.session.timeZone", zone)

    yield use
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_daylight_saving_overlap_is_exact(spark, in_zone):
    in_zone("America/Sao_Paulo")
    # 23:30 happened twice on 2018-02-17; both instants survive.
    seconds = [1518915600, 1518919200]
    df = spark.createDataFrame([(s * 1_000_000,) for s in seconds], "us bigint")
    back = df.select(micros_to_timestamp(F.col("us")).cast("bigint").alias("s"))
    assert rows(back) == [(s,) for s in seconds]


def test_truncation_is_toward_zero(spark):
    df = spark.createDataFrame([(-1_500_000,), (1_999_999,)], "us bigint")
    assert rows(df.select(micros_to_timestamp(F.col("us")).cast("bigint"))) == [(-1,), (1,)]
    micro = df.select(F.unix_micros(micros_to_timestamp(F.col("us"), "micro")))
    assert rows(micro) == [(-1_500_000,), (1_999_999,)]
    with pytest.raises(ValueError):
        micros_to_timestamp(F.col("us"), "hour")


def test_source_zone_turns_a_wall_clock_into_an_instant(spark):
    # The producer wrote 10:00 local time as if it were UTC.
    ten = int(datetime.datetime(2024, 9, 1, 10, tzinfo=datetime.timezone.utc).timestamp())
    df = spark.createDataFrame([(ten * 1_000_000,)], "us bigint")
    instant = micros_to_timestamp(F.col("us"), source_zone="America/Sao_Paulo").cast("bigint")
    assert rows(df.select(instant)) == [(ten + 3 * 3600,)]


def test_wall_clock_micros_ignore_the_session_zone(spark, in_zone):
    in_zone("America/Sao_Paulo")
    df = spark.sql("SELECT timestamp_ntz'2018-11-04 00:30:00.000001' AS t")  # a skipped hour
    expected = datetime.datetime(2018, 11, 4, 0, 30, 0, 1, tzinfo=datetime.timezone.utc)
    assert df.select(wall_clock_to_micros(F.col("t"))).first()[0] == round(expected.timestamp() * 1e6)
