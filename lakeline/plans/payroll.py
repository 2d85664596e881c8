"""Head-count per job title over distinct payroll rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.functions.text import strip, token
from lakeline.operators.counting import by_count, count_by
from lakeline.operators.rows import distinct_rows, split_rejects
from lakeline.sources.files import read_lines_without

# The separator, the token with the title, and the rule line's position.
SEPARATOR = ";"
TITLE_TOKEN = 1
RULE_POSITION = 1


def payroll_lines(
    spark: SparkSession, path: str, header: bool = False, encoding: str = "UTF-8"
) -> DataFrame:
    """The payroll without its rule line. The header counts as a row unless ``header`` drops it."""
    positions = (0, RULE_POSITION) if header else (RULE_POSITION,)
    return read_lines_without(spark, path, positions, encoding)


def title_of(lines: DataFrame, trim_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(title)`` per distinct line, and the distinct lines too short to hold one.

    Padded titles differ from unpadded ones unless ``trim_key`` strips them; an
    empty title is a title.
    """
    title = token(F.col("value"), SEPARATOR, TITLE_TOKEN)
    cut = distinct_rows(lines.select("value")).withColumn(
        "title", strip(title) if trim_key else title
    )
    good, rejected = split_rejects(cut, F.col("title").isNotNull())
    return good.select("title"), rejected.select("value")


def title_counts(lines: DataFrame, trim_key: bool = False) -> DataFrame:
    titles, _ = title_of(lines, trim_key)
    return by_count(count_by(titles, "title"), "title")
