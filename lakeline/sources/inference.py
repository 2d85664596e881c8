"""Column types of CSV files from one pass over all values, and the files where a type changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakeline.config import CsvOptions

#: Kinds of a value, by the narrowest type that holds it.
BLANK, INT, LONG, DECIMAL, DOUBLE, DATE, TIME, BOOLEAN, TEXT = (
    "blank", "int", "long", "decimal", "double", "date", "timestamp", "boolean", "text",
)
#: Each of these holds all values of the ones before it.
NUMBERS, TIMES = (INT, LONG, DECIMAL, DOUBLE), (DATE, TIME)
_TYPES = {INT: "int", LONG: "bigint", DOUBLE: "double", DATE: "date", TIME: "timestamp", BOOLEAN: "boolean"}

_WHOLE = r"^[+-]?[0-9]+$"
_FLOAT = r"^[\x00-\x20]*[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?)[\x00-\x20]*$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
#: Digits a decimal can have.
_MOST_DIGITS = 38


def kind_of(value: Column) -> Column:
    """The narrowest kind that holds a text; null and empty texts are blank."""
    digits = _digits(value)
    return (
        F.when(value.isNull() | (value == ""), BLANK)
        .when(value.rlike(_WHOLE) & value.try_cast("int").isNotNull(), INT)
        .when(value.rlike(_WHOLE) & value.try_cast("bigint").isNotNull(), LONG)
        .when(value.rlike(_WHOLE) & (digits <= _MOST_DIGITS), DECIMAL)
        .when(value.rlike(_FLOAT) | value.isin("Inf", "-Inf"), DOUBLE)
        .when(value.rlike(_DAY) & value.try_cast("date").isNotNull(), DATE)
        .when(value.try_cast("timestamp").isNotNull(), TIME)
        .when(F.lower(value).isin("true", "false"), BOOLEAN)
        .otherwise(TEXT)
    )


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"^[+-]?0*", ""))


def profile_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """What the values of each column are, over every value of every file.

    A row for each column and kind: ``position``, ``column``, ``kind``, ``n`` values, the
    most ``digits`` of a number without a point, and the ``first_file`` in path order that
    holds such a value. All of it merges in any order, so a task sends at most a row for each
    column and kind, and one pass over the files is enough for the types (``column_types``)
    and for the files where they change (``type_changes``). A column of an empty file is
    blank with no values. With a header all files must have the same one.
    """
    texts = _as_text(spark, path, options)
    names = F.array(*map(F.lit, texts.columns))
    cells = texts.select(
        F.col("_metadata.file_path").alias("file"),
        F.posexplode(F.array(*(F.col(_quoted(c)) for c in texts.columns))).alias("position", "value"),
    )
    seen = (
        cells.groupBy("position", kind_of(F.col("value")).alias("kind"))
        .agg(
            F.count("*").alias("n"),
            F.max(F.when(F.col("value").rlike(_WHOLE), _digits(F.col("value")))).alias("digits"),
            F.min("file").alias("first_file"),
        )
        .select("position", "kind", "n", "digits", "first_file")
    )
    # Columns without a row of their own, if there are no lines at all.
    every = spark.range(len(texts.columns)).select(F.col("id").cast("int").alias("position"))
    return every.join(seen, "position", "left").select(
        "position",
        F.element_at(names, F.col("position") + 1).alias("column"),
        F.coalesce("kind", F.lit(BLANK)).alias("kind"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "digits",
        "first_file",
    )


def _as_text(spark: SparkSession, path: str, options: CsvOptions) -> DataFrame:
    reader = spark.read.options(
        header=options.header, sep=options.delimiter, encoding=options.encoding, inferSchema=False
    )
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # A file whose header differs stops the job instead of being misread.
    return reader.schema(schema).option("enforceSchema", not options.header).csv(path)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def joined_type(kinds: Column, digits: Column) -> Column:
    """The type that holds all these kinds, as DDL; only blanks are text."""
    filled = F.array_remove(kinds, BLANK)

    def only(*allowed: str) -> Column:
        return F.size(F.array_except(filled, F.array(*map(F.lit, allowed)))) == 0

    def widest(order: tuple[str, ...]) -> list[tuple[Column, str]]:
        return [(only(*order[: i + 1]), kind) for i, kind in enumerate(order)]

    # A bigint beside a decimal keeps all its digits.
    whole = F.greatest(digits, F.when(F.array_contains(filled, LONG), 20), F.lit(10))
    decimal = F.concat(F.lit("decimal("), whole.cast("string"), F.lit(",0)"))
    result = F.when(F.size(filled) == 0, "string")
    for fits, kind in [*widest(NUMBERS), *widest(TIMES), (only(BOOLEAN), BOOLEAN)]:
        result = result.when(fits, decimal if kind == DECIMAL else F.lit(_TYPES.get(kind, "string")))
    return result.otherwise("string")


def column_types(profile: DataFrame) -> DataFrame:
    """``position``, ``column``, its ``type``, how many ``values`` and ``blanks`` it has."""
    blank = F.col("kind") == BLANK
    digits = F.max(F.when(F.col("kind").isin(DECIMAL), F.col("digits")))
    return profile.groupBy("position", "column").agg(
        joined_type(F.collect_set("kind"), digits).alias("type"),
        F.coalesce(F.sum(F.when(~blank, F.col("n"))), F.lit(0)).alias("values"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blanks"),
    )


def type_changes(profile: DataFrame) -> DataFrame:
    """Files, in path order, whose values widen the type of the files before them.

    ``position``, ``column``, ``file``, and the type ``before`` and ``after`` it. The first
    file that has values changes nothing. A column has at most as many changes as kinds, since
    only a file that is the first with some kind can widen a type: no row per file is needed.
    A decimal with more digits is no change of its own.
    """
    files = Window.partitionBy("position").orderBy("first_file")
    so_far = files.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    digits = F.max(F.when(F.col("kind") == DECIMAL, F.col("digits"))).over(so_far)
    joined = profile.where((F.col("kind") != BLANK) & (F.col("n") > 0)).select(
        "position", "column", F.col("first_file").alias("file"),
        joined_type(F.collect_set("kind").over(so_far), digits).alias("after"),
    ).distinct()
    in_order = Window.partitionBy("position").orderBy("file")
    return joined.withColumn("before", F.lag("after").over(in_order)).where("before <> after").select(
        "position", "column", "file", "before", "after"
    )


def infer_schema(profile: DataFrame) -> T.StructType:
    """The schema to read the files with; only a row for each column reaches the driver."""
    found = column_types(profile).orderBy("position").collect()
    return T.StructType(
        [T.StructField(r.column, T.StructType.fromDDL(f"c {r.type}")[0].dataType) for r in found]
    )
