"""Types of CSV columns from one pass, against the reader's own inference."""

from __future__ import annotations

import itertools

import pytest
from helpers import rows

from lakeline.config import CsvOptions
from lakeline.sources import column_types, infer_schema, profile_csv, read_csv, type_changes

BIG = "9" * 20
COLUMNS = [
    ["1", "2"], ["1", "3000000000"], ["+5", "-0"], ["1", BIG], [BIG, "1.5"], ["1" * 38, BIG],
    ["3000000000", BIG], ["3000000000", "9" * 19], ["1" * 39, "1"], ["1e5", "7"], ["5d", ".5"], ["NaN", "-Inf"],
    ["2024-01-05", "2024-02-29"], ["2024-01-05", "2024-01-05 10:00:00"], ["2024-1-5", "2024-01-05"],
    ["2024-01-05T10:00:00Z", "2024-01-05 10:00"], ["2024-13-01", "2024-01-05"], ["TRUE", "false"],
    ["true", "5"], ["5", "2024-01-05"], ["t", "x"], ["", "7"], ["", ""], ["1_000", "1"], [" 5", "6"],
]


def write(path, names, *lines):
    path.write_text("\n".join([";".join(names), *map(";".join, lines)]) + "\n")


def test_types_are_those_of_the_whole_file(spark, tmp_path):
    names = [f"c{i}" for i in range(len(COLUMNS))]
    write(tmp_path / "a.csv", names, *zip(*COLUMNS, strict=True))
    expected = {f.name: f.dataType for f in read_csv(spark, str(tmp_path)).schema}
    found = {f.name: f.dataType for f in infer_schema(profile_csv(spark, str(tmp_path)))}
    assert found == expected


@pytest.mark.parametrize("order", list(itertools.permutations(["3000000000", BIG, "1.5"])))
def test_the_order_of_files_does_not_matter_for_types(spark, tmp_path, order):
    for i, value in enumerate(order):
        write(tmp_path / f"{i}.csv", ["a", "b"], [value, "7"])
    assert infer_schema(profile_csv(spark, str(tmp_path))).simpleString() == "struct<a:double,b:int>"


def test_a_column_that_changes_in_the_last_file(spark, tmp_path):
    write(tmp_path / "1.csv", ["id", "on", "note"], ["1", "2024-01-01", ""], ["2", "2024-01-02", ""])
    write(tmp_path / "2.csv", ["id", "on", "note"], ["3000000000", "2024-01-03", "x"])
    write(tmp_path / "3.csv", ["id", "on", "note"], ["n/a", "2024-01-03 10:00:00", "5"])
    profile = profile_csv(spark, str(tmp_path))
    changes = type_changes(profile).collect()
    assert sorted((r.column, r.file.rsplit("/", 1)[1], r.before, r.after) for r in changes) == [
        ("id", "2.csv", "int", "bigint"),
        ("id", "3.csv", "bigint", "string"),
        ("on", "3.csv", "date", "timestamp"),
    ]
    assert rows(column_types(profile).drop("position")) == [
        ("id", "string", 4, 0), ("note", "string", 2, 2), ("on", "timestamp", 4, 0),
    ]


def test_the_files_are_scanned_once(spark, tmp_path):
    write(tmp_path / "1.csv", ["a", "b"], ["1", "x"])
    profile = profile_csv(spark, str(tmp_path))
    plan = column_types(profile)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_files_without_lines_and_odd_names(spark, tmp_path):
    write(tmp_path / "1.csv", ["a b", "c`d", "e.f"])
    profile = profile_csv(spark, str(tmp_path))
    assert rows(column_types(profile).select("column", "type", "values", "blanks")) == [
        ("a b", "string", 0, 0), ("c`d", "string", 0, 0), ("e.f", "string", 0, 0),
    ]
    assert type_changes(profile).count() == 0


def test_files_of_other_headers_stop_the_job(spark, tmp_path):
    write(tmp_path / "1.csv", ["a", "b"], ["1", "2"])
    write(tmp_path / "2.csv", ["b", "a"], ["1", "2"])
    with pytest.raises(Exception, match="header"):
        profile_csv(spark, str(tmp_path)).collect()


def test_files_without_a_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text("1,x\n2,y\n")
    found = profile_csv(spark, str(tmp_path), CsvOptions(header=False, delimiter=","))
    assert infer_schema(found).simpleString() == "struct<_c0:int,_c1:string>"
