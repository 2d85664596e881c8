"""Text functions, line scans and the tab-separated sink."""

from __future__ import annotations

import math

import pytest
from helpers import rows
from pyspark.sql import functions as F

from lakeline.functions.text import (
    after_last,
    contains_all,
    float_text,
    lenient_double,
    remove,
    strip,
    token,
    tokens,
)
from lakeline.sinks import write_tsv
from lakeline.sources import read_key_values, read_lines, read_lines_without


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def python_float(text):
    try:
        return float(text.strip())
    except ValueError:
        return None


SPELLINGS = [
    "1", " 1.5 ", "-2.", "+.5", "1e5", "1E-3", "1_000", "1_0.0_1", "1__0", "_1", "1_", "1_.5",
    "1._5", "1_e5", "1.5f", "2d", "2D", "0x1p3", "0x1", "", " ", ".", "e5", "1e", "--1", "+-1",
    "nan", "NaN", "+nan", "-NAN", "inf", "-inf", "+Infinity", "infinit", "1,5", "$1", "1 2",
    "\t7\r\n", " 8　", "\x1c9\x85", "1e400", "12345678901234567890", "n", "+n", "nanf",
]


def test_lenient_double_agrees_with_python(lines):
    found = one(lines(*SPELLINGS), lenient_double(F.col("value")))
    for text, value in zip(SPELLINGS, found, strict=True):
        expected = python_float(text)
        if expected is not None and math.isnan(expected):
            assert math.isnan(value), text
        else:
            assert value == expected, text


def test_lenient_double_survives_long_text(lines):
    long = ["1" * 200_000 + "x", "1_" * 100_000 + "1", "_" * 100_000]
    assert one(lines(*long), lenient_double(F.col("value"))) == [None, math.inf, None]


def test_float_text_is_what_python_prints(spark):
    values = [238772.0, 12345678.9, 1e15, 0.0, -3.5e9, 0.1, 1e-4, 0.00012345678901234567, -7.25]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    assert one(df, float_text(F.col("d"))) == [repr(v) for v in values]


def test_strip_removes_what_python_strips(lines):
    texts = ["  a b ", "\t\r\na\n", " a ", "\x1fa\x85", "​a", ""]
    assert one(lines(*texts), strip(F.col("value"))) == [t.strip() for t in texts]


def test_tokens_keep_empty_ones(lines):
    df = lines("a;;b;", "a|b", "")
    assert one(df, tokens(F.col("value"), ";")) == [["a", "", "b", ""], ["a|b"], [""]]
    assert one(df, tokens(F.col("value"), "|")) == [["a;;b;"], ["a", "b"], [""]]


def test_missing_tokens_are_null(lines):
    df = lines("a;b;c", "a")
    assert one(df, token(F.col("value"), ";", 1)) == ["b", None]
    assert one(df, token(F.col("value"), ";", 2)) == ["c", None]
    assert one(df, token(F.col("value"), ";", -2)) == ["b", None]
    assert one(df, token(F.col("value"), ";", -1)) == ["c", "a"]


def test_literals_are_no_patterns(lines):
    df = lines("user=<a=<b>,", "$5$", "plain")
    assert one(df, after_last(F.col("value"), "=<")) == ["b>,", "$5$", "plain"]
    assert one(df, remove(F.col("value"), "$")) == ["user=<a=<b>,", "5", "plain"]
    assert one(df, contains_all(F.col("value"), ["=<", "user"])) == [True, False, False]


def test_lines_keep_blanks_and_tabs(spark, tmp_path):
    file = tmp_path / "log.txt"
    file.write_bytes(b"a\tb\r\n\n  \nlast")
    assert one(read_lines(spark, str(file)), "value") == ["a\tb", "", "  ", "last"]


def test_line_encodings(spark, tmp_path):
    file = tmp_path / "latin.txt"
    file.write_bytes("JOÃO;É\n\nfim".encode("latin-1"))
    assert one(read_lines(spark, str(file), "latin-1"), "value") == ["JOÃO;É", "", "fim"]
    # Read as UTF-8, different damaged bytes become the same replacement character.
    assert one(read_lines(spark, str(file)), "value") == ["JO�O;�", "", "fim"]
    damaged = tmp_path / "damaged.txt"
    damaged.write_bytes(b"\xc3;x\n\xc9;x\n")
    assert read_lines(spark, str(damaged)).distinct().count() == 1
    with pytest.raises(ValueError):
        read_lines(spark, str(file), "utf-16")


def test_dropping_lines_by_position_in_a_large_file(spark, tmp_path):
    file = tmp_path / "with space & 100%.txt"
    count = 50_000
    file.write_text("".join(f"line {i}\n" for i in range(count)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        kept = read_lines_without(spark, str(file), (1,))
        assert kept.rdd.getNumPartitions() > 4
        assert set(one(kept, "value")) == {f"line {i}" for i in range(count)} - {"line 1"}
        kept = one(read_lines_without(spark, str(file), (0, 1)), "value")
        assert len(kept) == count - 2 and not {"line 0", "line 1"} & set(kept)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_positions_count_on_across_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    (tmp_path / "b.txt").write_text("first\n")
    (tmp_path / "c.txt").write_text("second\nthird\n")
    (tmp_path / "d.txt").write_text("second\n" * 50)
    kept = one(read_lines_without(spark, str(tmp_path), (1,)), "value")
    assert sorted(kept) == ["first", *["second"] * 50, "third"]


def test_later_files_are_scanned_without_numbering(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(f"{name}1\n{name}2\n{name}3\n")
    plan = read_lines_without(spark, str(tmp_path), (1,))
    assert sorted(one(plan, "value")) == ["a1", "a3", "b1", "b2", "b3", "c1", "c2", "c3"]


def test_one_line_has_no_second(spark, tmp_path):
    file = tmp_path / "one.txt"
    file.write_text("only\n")
    assert one(read_lines_without(spark, str(file), (1,)), "value") == ["only"]


def test_tsv_is_written_without_quoting(spark, folder):
    df = spark.createDataFrame(
        [(238772.0, '"Doe, Jo"'), (12345678.0, "tab\there"), (None, None)], "s double, name string"
    )
    path = folder("out")
    write_tsv(df, path)
    assert rows(read_lines(spark, path)) == [("\t",), ('12345678.0\ttab\there',), ('238772.0\t"Doe, Jo"',)]
    pairs = rows(read_key_values(spark, path))
    assert ("12345678.0", "tab\there") in pairs and ("238772.0", '"Doe, Jo"') in pairs
