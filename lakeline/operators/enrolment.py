"""Enrolment queries over a student table; all column names are parameters."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.operators.counting import count_by, top_k


@dataclass(frozen=True)
class StudentColumns:
    """Where the student table keeps what the queries need."""

    # Names of the student file.
    admission: str = "forma_ingresso"
    sex: str = "sexo"
    course: str = "nome_curso"
    intake_date: str = "intake_date"
    birth_year: str = "birth_year"


COLUMNS = StudentColumns()


@dataclass(frozen=True)
class Period:
    """A half-open range of dates: ``start <= date < end``."""

    start: datetime.date
    end: datetime.date

    def holds(self, date: Column) -> Column:
        return (date >= F.lit(self.start)) & (date < F.lit(self.end))


def matching(
    students: DataFrame,
    admission: str | None = None,
    sex: str | None = None,
    course: str | None = None,
    period: Period | None = None,
    columns: StudentColumns = COLUMNS,
) -> DataFrame:
    """Students that meet every condition given; plain predicates, so they reach the scan."""
    wanted = {columns.admission: admission, columns.sex: sex, columns.course: course}
    for name, value in wanted.items():
        if value is not None:
            students = students.where(F.col(name) == value)
    if period is not None:
        students = students.where(period.holds(F.col(columns.intake_date)))
    return students


def how_many(students: DataFrame, name: str = "n") -> DataFrame:
    """One row with the number of students; 0 when there are none."""
    return students.agg(F.count(F.lit(1)).alias(name))


def sex_counts(students: DataFrame, columns: StudentColumns = COLUMNS) -> DataFrame:
    return count_by(students, columns.sex, name="count")


def top_courses(students: DataFrame, k: int = 5, columns: StudentColumns = COLUMNS) -> DataFrame:
    counts = count_by(students, columns.course, name="count")
    return top_k(counts, k, "count", ties=[columns.course])


def age_distribution(students: DataFrame, columns: StudentColumns = COLUMNS) -> DataFrame:
    """Students per age in the year they entered."""
    age = F.year(columns.intake_date) - F.col(columns.birth_year)
    return count_by(students, age.cast("bigint").alias("age"), name="count")
