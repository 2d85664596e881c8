"""Lake files and tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.config import TIMESTAMP_FORMAT
from lakeline.functions.text import float_text


def write_lake_csv(df: DataFrame, path: str) -> None:
    """Add readings to a lake directory as CSV with a header."""
    (
        df.write.mode("append")
        .option("header", True)
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .csv(path)
    )


def write_lake_json(df: DataFrame, path: str) -> None:
    """Add readings to a lake directory as JSON lines; NULL fields are left out."""
    (
        df.write.mode("append")
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .json(path)
    )


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated text without quoting; floats keep a plain decimal point."""
    cells = [_cell(f) for f in df.schema]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.mode(mode).text(path)


def _cell(field: T.StructField):
    value = F.col(f"`{field.name}`")
    text = float_text(value) if isinstance(field.dataType, T.DoubleType) else value.cast("string")
    return F.coalesce(text, F.lit(""))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, on whichever file system it is; none if there is no such folder."""
    folder, system = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern with wildcards."""
    files, system = _file_system(spark, pattern)
    return [s.getPath().toString() for s in system.globStatus(files) or []]


def create_marker(spark: SparkSession, path: str) -> None:
    """An empty file; there may be one already."""
    file, system = _file_system(spark, path)
    system.create(file, True).close()


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote this directory came to its end."""
    return "_SUCCESS" in children(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a directory; there may be none."""
    folder, system = _file_system(spark, path)
    system.delete(folder, True)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
