"""Enrolment queries, the CSV reader and the whole job."""

from __future__ import annotations

import datetime

import pytest
from helpers import rows
from pyspark.errors import AnalysisException

from lakeline.config import CsvOptions, DocTarget, JobConfig
from lakeline.operators.enrolment import (
    Period,
    age_distribution,
    how_many,
    matching,
    sex_counts,
    top_courses,
)
from lakeline.plans.enrolments import load_students
from lakeline.sources import read_csv

D = datetime.date


@pytest.fixture
def students(spark):
    return spark.createDataFrame(
        [
            ("SiSU", "M", "FISICA", D(2020, 2, 1), 2001),
            ("SiSU", "F", "FISICA", D(2020, 8, 1), 2002),
            ("SiSU", "F", "LETRAS", D(2021, 2, 1), 2000),
            ("REOPCAO", "F", "LETRAS", D(2021, 2, 1), 1990),
            (None, "M", None, None, None),
        ],
        "forma_ingresso string, sexo string, nome_curso string, intake_date date, birth_year int",
    )


def test_conditions(students):
    assert how_many(matching(students, "SiSU")).first().n == 3
    assert how_many(matching(students, "SiSU", sex="F", course="LETRAS")).first().n == 1
    assert how_many(matching(students, "nowhere")).first().n == 0


def test_period_is_half_open(students):
    year = Period(D(2020, 2, 1), D(2021, 2, 1))
    assert how_many(matching(students, period=year)).first().n == 2
    assert how_many(matching(students, "SiSU", period=Period(D(2021, 2, 1), D(2022, 1, 1)))).first().n == 1


def test_distributions(students):
    assert rows(sex_counts(students)) == [("F", 3), ("M", 2)]
    assert rows(sex_counts(matching(students, "SiSU"))) == [("F", 2), ("M", 1)]
    assert rows(age_distribution(matching(students, "SiSU"))) == [(18, 1), (19, 1), (21, 1)]


def test_top_courses_break_ties_by_name(students):
    assert [tuple(r) for r in top_courses(students, 2).collect()] == [("FISICA", 2), ("LETRAS", 2)]
    assert top_courses(students).count() == 3  # no course is a group too


def test_csv_with_schema_checks_the_header(spark, tmp_path):
    file = tmp_path / "s.csv"
    file.write_text("sexo;forma_ingresso\nM;SiSU\n")
    loaded = read_csv(spark, str(file))
    assert loaded.first().asDict() == {"sexo": "M", "forma_ingresso": "SiSU"}
    wrong = CsvOptions(schema=loaded.select("forma_ingresso", "sexo").schema)
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(file), wrong).collect()


def test_csv_encoding(spark, tmp_path):
    file = tmp_path / "s.csv"
    file.write_bytes("curso\nFÍSICA\n".encode("latin-1"))
    loaded = read_csv(spark, str(file), CsvOptions(encoding="ISO-8859-1"))
    assert loaded.first().curso == "FÍSICA"


@pytest.mark.parametrize("staged", [False, True])
def test_job_saves_every_collection_once(spark, students, folder, staged):
    source = folder("input")
    students.drop("intake_date").write.option("header", True).option("sep", ";").csv(source)
    config = JobConfig(input_path=source)

    def target(collection):
        return DocTarget.json_files(folder("docs", collection or config.collection))

    load_students(spark, config, target, staging=folder("stage") if staged else None)

    def saved(name):
        return spark.read.json(folder("docs", name))

    assert saved("discentes").count() == 5
    assert saved("sisu").count() == 3
    assert saved("sisu_masculino").count() == 1
    assert rows(saved("sexo").select("sexo", "count")) == [("F", 3), ("M", 2)]
    assert saved("cursos").count() == 3
    with pytest.raises(AnalysisException):
        load_students(spark, config, target)  # everything exists already


def test_job_needs_an_input(spark):
    with pytest.raises(ValueError, match="input path"):
        load_students(spark, JobConfig(url="mongodb://example.invalid/"))
