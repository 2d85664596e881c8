"""Parse a salary list and find the highest salaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.functions.text import lenient_double, remove, strip_left, strip_right, tokens
from lakeline.operators.counting import top_k
from lakeline.operators.rows import split_rejects

# The name is the first two tokens, the salary the last but one.
SEPARATOR = ","
CURRENCY = "$"
SALARY_TOKEN = -2
TOP = 6


def parse_salaries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(salary, name)`` of every line with a salary, and the lines without one.

    Lines with fewer than two tokens are neither.
    """
    good, rejected = split_rejects(_parsed(lines), F.col("salary").isNotNull())
    return good.select("salary", "name"), rejected.select("value")


def top_salaries(lines: DataFrame, k: int = TOP) -> DataFrame:
    return top_k(_parsed(lines).select("salary", "name"), k, "salary", ties=["name"])


def _parsed(lines: DataFrame) -> DataFrame:
    line = F.col("value")
    # Two tokens or more is the same as a separator somewhere, and cheaper to test.
    long_enough = lines.where(line.contains(SEPARATOR))
    words = tokens(line, SEPARATOR)  # written once, split once per projected row
    # Stripping the ends of the name and of the amount also strips the line's own.
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    name = strip_right(F.concat(strip_left(first), F.lit(", "), second))
    salary = lenient_double(remove(F.try_element_at(words, F.lit(SALARY_TOKEN)), CURRENCY))
    return long_enough.select("value", salary.alias("salary"), name.alias("name"))
