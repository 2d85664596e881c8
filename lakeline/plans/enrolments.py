"""Load a student file into a document store together with its summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from lakeline.config import DocTarget, JobConfig
from lakeline.operators.enrolment import (
    COLUMNS,
    Period,
    StudentColumns,
    age_distribution,
    how_many,
    matching,
    sex_counts,
    top_courses,
)
from lakeline.session import scratch_path
from lakeline.sinks.stores import write_docs
from lakeline.sources.files import read_csv

# The admission and sex the job asks for.
ADMISSION = "SiSU"
SEX = "M"


def summaries(
    students: DataFrame,
    admission: str = ADMISSION,
    sex: str = SEX,
    columns: StudentColumns = COLUMNS,
) -> dict[str, DataFrame]:
    """The job's results by collection name, all lazy."""
    # The names of the collections.
    return {
        "sisu": matching(students, admission, columns=columns),
        "sexo": sex_counts(students, columns),
        "cursos": top_courses(students, 5, columns),
        "sisu_masculino": matching(students, admission, sex, columns=columns),
    }


def answers(
    students: DataFrame,
    admission: str = ADMISSION,
    sex: str | None = None,
    course: str | None = None,
    period: Period | None = None,
    columns: StudentColumns = COLUMNS,
) -> dict[str, DataFrame]:
    """The questions about students of an admission, by collection name, all lazy.

    Those about a period or a course are there if one is given; ``sex`` narrows all.
    """

    def chosen(**more: object) -> DataFrame:
        return matching(students, admission, sex, columns=columns, **more)

    found = {
        "ages": age_distribution(chosen(), columns),
        "sexes_by_admission": sex_counts(chosen(), columns),
        "top_courses_by_admission": top_courses(chosen(), 5, columns),
    }
    if period is not None:
        found["count_in_period"] = how_many(chosen(period=period))
        found["top_courses_in_period"] = top_courses(chosen(period=period), 5, columns)
    if course is not None:
        found["count_in_course"] = how_many(chosen(course=course))
    return found


def load_students(
    spark: SparkSession,
    config: JobConfig,
    target: Callable[[str | None], DocTarget] | None = None,
    mode: str = "errorifexists",
    staging: str | None = None,
    admission: str = ADMISSION,
    sex: str = SEX,
    columns: StudentColumns = COLUMNS,
    questions: Mapping[str, object] | None = None,
) -> dict[str, DataFrame]:
    """Save the students and each summary once; a failing write is raised.

    ``target`` gives the store of a collection (``None``: the students' own). The
    parsed file is first written to ``staging`` as Parquet (by default in the shared
    scratch folder), and the summaries read only the columns they need from there,
    so the CSV is parsed once. ``questions`` holds arguments of ``answers``, whose
    results are saved as well.
    """
    if not config.input_path:
        raise ValueError("the input path must come from the caller")
    target = target or config.documents
    students = read_csv(spark, config.input_path, config.csv())
    staging = staging or scratch_path(spark, "students")
    students.write.mode(mode).parquet(staging)
    students = spark.read.parquet(staging)
    write_docs(students, target(None), mode)
    results = summaries(students, admission, sex, columns)
    if questions is not None:
        results |= answers(students, columns=columns, **questions)
    for collection, result in results.items():
        write_docs(result, target(collection), mode)
    return results
