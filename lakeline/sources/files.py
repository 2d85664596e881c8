"""Files: text lines, CSV, lake files and file stand-ins for a topic."""

from __future__ import annotations

import codecs
import re
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from lakeline.config import CsvOptions
from lakeline.schemas import DAMAGED, MESSAGE, READING, with_damaged

#: The file source passes over files this much older than the newest one: none.
ANY_AGE = "36500d"


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """One row per line, blank lines included; splits large files across tasks.

    The text source passes a line's bytes through unchanged, so they are decoded
    here. Bytes that are not valid UTF-8 become U+FFFD.
    """
    return _decoded(spark.read.text(path), encoding).select("value")


def read_lines_without(
    spark: SparkSession, path: str, positions: Collection[int] = (1,), encoding: str = "UTF-8"
) -> DataFrame:
    """Lines of the path without those at the given zero-based positions.

    Lines count on from file to file in path order. Only the first few lines of
    the leading file are read to find the victims, and files behind them are
    scanned without numbering.
    """
    text = _decoded(spark.read.text(path), encoding).withColumn("_file", F.col("_metadata.file_path"))
    last = max(positions)
    seen = 0
    numbered_files: list[str] = []
    kept: list[DataFrame] = []
    for file in sorted(_metadata_path(f) for f in spark.read.text(path).inputFiles()):
        # Ids rise with the position in the file; those of its first split are 0, 1, 2 and so on,
        # however many cores read the rest.
        lines = text.where(F.col("_file") == file).withColumn(
            "_id", F.monotonically_increasing_id()
        )
        # Taken from the first partition on, stopping as soon as there are enough.
        ids = [row[0] for row in lines.select("_id").limit(last + 1 - seen).collect()]
        victims = [i for position, i in enumerate(ids, seen) if position in positions]
        kept.append(lines.where(~F.col("_id").isin(victims)).select("value"))
        numbered_files.append(file)
        seen += len(ids)
        if seen > last:
            break
    result = text.where(~F.col("_file").isin(numbered_files)).select("value")
    for part in kept:
        result = part.unionByName(result)
    return result


def _decoded(text: DataFrame, encoding: str) -> DataFrame:
    charset = codecs.lookup(encoding).name
    if charset == "utf-8":
        value = F.make_valid_utf8("value")
    elif charset == "iso8859-1":
        value = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    else:
        raise ValueError(f"lines are read as UTF-8 or ISO-8859-1, not {encoding}")
    return text.withColumn("value", value)


def _metadata_path(uri: str) -> str:
    """The spelling ``_metadata.file_path`` uses: one slash after a scheme without a host."""
    return re.sub(r"^([A-Za-z][\w+.-]*):///", r"\1:/", uri)


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    reader = (
        spark.read.option("header", options.header)
        .option("sep", options.delimiter)
        .option("encoding", options.encoding)
    )
    if options.schema is not None:
        # The header must then agree with the schema instead of being ignored.
        reader = reader.schema(options.schema).option("enforceSchema", not options.header)
    else:
        reader = reader.option("inferSchema", options.infer_schema)
    return reader.csv(path)


def read_sensor_csv(spark: SparkSession, path: str, schema: StructType = READING) -> DataFrame:
    """All readings in ``.csv`` files of a lake directory, with a header line each."""
    return _undamaged(_sensor_csv(spark.read, path, schema))


def read_sensor_json(spark: SparkSession, path: str, schema: StructType = READING) -> DataFrame:
    """All readings in ``.json`` files of a lake: one object, or one array of them, per line.

    One task reads a line; ``read_json_readings`` splits long ones.
    """
    return _undamaged(_sensor_json(spark.read, path, schema))


def read_sensor_lake(spark: SparkSession, path: str, schema: StructType = READING) -> DataFrame:
    """Every reading of a lake directory, whichever of the two formats holds it."""
    return read_sensor_csv(spark, path, schema).unionByName(read_sensor_json(spark, path, schema))


def read_lake_rejects(spark: SparkSession, path: str, schema: StructType = READING) -> DataFrame:
    """Lines of a lake directory that are no reading: ``value``, and what could be read of them.

    A number or time that does not parse, a missing field or a cut JSON text damages
    the whole line, so that it is not taken for a burnt-out sensor.
    """
    lines = _sensor_csv(spark.read, path, schema).unionByName(_sensor_json(spark.read, path, schema))
    return _judged(lines, F.col(DAMAGED).isNotNull()).withColumnRenamed(DAMAGED, "value")


def stream_sensor_lake(
    spark: SparkSession, path: str, schema: StructType = READING, **options: str
) -> DataFrame:
    """The lake directory as a stream: a job that resumes from its checkpoint reads new files only.

    However old a file is, it is read. ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``
    bound a micro-batch. Give ``cleanSource`` (``archive`` or ``delete``) to bound the
    list of files seen, if no other job reads the directory.
    """
    options = {"maxFileAge": ANY_AGE, **options}
    readings = _sensor_csv(spark.readStream.options(**options), path, schema).unionByName(
        _sensor_json(spark.readStream.options(**options), path, schema)
    )
    return _undamaged(readings)


def lake_lines(
    reader: DataFrameReader, paths: list[str], schema: StructType, kind: str
) -> DataFrame:
    """Every line of these files of one kind, ``csv`` or ``json``; the text of damaged ones beside."""
    return {"csv": _sensor_csv, "json": _sensor_json}[kind](reader, paths, schema)


def _undamaged(lines: DataFrame) -> DataFrame:
    return _judged(lines, F.col(DAMAGED).isNull()).drop(DAMAGED)


def _judged(lines: DataFrame, verdict: Column) -> DataFrame:
    # The readers parse only what a query uses, and would not see damage elsewhere in the line:
    # this condition, which always holds, uses all columns.
    marks = [F.col(c).isNull() for c in lines.columns if c != DAMAGED]
    return lines.where(verdict & (F.size(F.array(*marks)) == len(marks)))


def _sensor_csv(
    reader: DataFrameReader | DataStreamReader, path: str | list[str], schema: StructType
) -> DataFrame:
    # The header must agree with the schema instead of being ignored.
    return (
        reader.schema(with_damaged(schema))
        .option("columnNameOfCorruptRecord", DAMAGED)
        .option("pathGlobFilter", "*.csv")
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )


def _sensor_json(
    reader: DataFrameReader | DataStreamReader, path: str | list[str], schema: StructType
) -> DataFrame:
    return (
        reader.schema(with_damaged(schema))
        .option("columnNameOfCorruptRecord", DAMAGED)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``key<TAB>value``; the value may hold further tabs."""
    pair = F.split("value", "\t", 2)
    return spark.read.text(path).select(
        F.get(pair, F.lit(0)).alias("key"), F.get(pair, F.lit(1)).alias("value")
    )


def read_envelope_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of messages from JSON files, in place of a topic.

    However old a file is, it is read. ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``
    bound a micro-batch.
    """
    options = {"maxFileAge": ANY_AGE, **options}
    return spark.readStream.schema(MESSAGE).options(**options).json(path)
