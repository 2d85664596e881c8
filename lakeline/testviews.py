"""The logical tables, defined over the star-schema test tables.

Text tables are rendered line by line from the rows, so that parsing them back
can be checked against SQL over the original columns.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.functions.times import wall_clock_to_micros
from lakeline.operators.enrolment import StudentColumns

STUDENT_COLUMNS = StudentColumns(
    admission="admission",
    sex="sex",
    course="course",
    intake_date="intake_date",
    birth_year="birth_year",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A test table as a stream, read in place.

    The last letter is a glob, since a streaming source takes a single file only
    by pattern; it matches a directory of part files as well.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{sf_dir}/{name}.parque[t]")


def _rendered(df: DataFrame, line: Column, *keep: str) -> DataFrame:
    """Rows as text lines in ``value``.

    A stored line is there once, but the optimizer would render a computed one
    again for every test on it; unpacking a one-element array keeps it from that.
    """
    return df.select(F.explode(F.array(line)).alias("value"), *keep)


def sensors(events: DataFrame) -> DataFrame:
    """Readings per sensor; error events stand for burnt-out sensors, half of them silent."""
    burnt_out = F.when(F.col("event_id") % 2 == 0, F.lit(-1.0))
    measurement = F.when(F.col("event_type") == "error", burnt_out).otherwise(F.col("value"))
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("s"), F.col("user_id")).alias("sensor_id"),
        F.col("event_type").alias("sensor_type"),
        measurement.alias("measurement"),
        F.col("ts").alias("timestamp"),
    )


def instants(readings: DataFrame) -> DataFrame:
    """The same readings with TIMESTAMP times, which watermarks require."""
    return readings.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def wall_clock(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def mail_log(events: DataFrame, nameless: str | None = None) -> DataFrame:
    """Server log lines; clicks are logins, everything else an aborted one.

    Events of the ``nameless`` type become logins without a user.
    """
    day = F.lpad((F.dayofmonth("ts") % 20 + 10).cast("string"), 2, "0")
    kind = F.col("event_type")
    no_name = (kind == nameless) if nameless else F.lit(False)
    action = F.when((kind == "click") | no_name, "Login").otherwise("Aborted login")
    user = F.when(no_name, "").otherwise(F.concat(F.lit("u"), F.col("user_id")))
    line = F.concat(
        F.lit("Jun "),
        day,
        F.lit(" "),
        F.date_format("ts", "HH:mm:ss"),
        F.lit(" mailhost dovecot: imap-login: "),
        action,
        F.lit(": user=<"),
        user,
        F.lit(">, method=PLAIN"),
    )
    return _rendered(events, line)


def salaries(customer: DataFrame, balance: Column | None = None) -> DataFrame:
    """Salary list lines with a quoted name of two tokens and two amounts."""
    amount = F.col("c_acctbal").cast("string") if balance is None else balance
    line = F.concat(
        F.lit('"'),
        F.col("c_name"),
        F.lit(",X"),
        F.col("c_custkey"),
        F.lit('",'),
        F.col("c_mktsegment"),
        F.lit(",$"),
        amount,
        F.lit(",$0.00"),
    )
    return _rendered(customer, line)


def bracketed_debts() -> Column:
    """Balances as a bookkeeper writes them: ``(12.5)`` for a debt, which is no number."""
    balance = F.col("c_acctbal")
    debt = F.concat(F.lit("("), F.abs(balance).cast("string"), F.lit(")"))
    return F.when(balance < 0, debt).otherwise(balance.cast("string"))


#: The line under the first row of a payroll, which is no person.
RULE = "-----;-----"


def payroll(orders: DataFrame) -> DataFrame:
    """Payroll lines: a person and a job title, with repeated rows.

    The line at ``position`` 1, between the first and the second person, is a rule.
    """
    line = F.concat(F.col("o_custkey"), F.lit(";"), F.col("o_orderpriority"))
    numbered = orders.withColumn("position", F.col("o_orderkey") * 2)
    rule = orders.agg((F.min("o_orderkey") * 2 + 1).alias("position"))
    return _rendered(numbered, line, "position").unionByName(
        rule.select(F.lit(RULE).alias("value"), "position")
    )


def students(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("admission"),
        F.col("o_orderstatus").alias("sex"),
        F.concat(F.lit("CURSO_"), F.col("o_custkey") % 25).alias("course"),
        F.col("o_orderdate").alias("intake_date"),
        (F.year("o_orderdate") - 17 - F.col("o_custkey") % 30).cast("bigint").alias("birth_year"),
    )


def envelopes(readings: DataFrame) -> DataFrame:
    """Readings as insert messages: JSON text with the row image under ``payload.after``."""
    return readings.select(_change(F.lit("c"), F.lit(True)).alias("value"))


def mixed_envelopes(readings: DataFrame) -> DataFrame:
    """Messages of every kind: signups are deletes, views snapshots, purchases tombstones or damaged."""
    kind = F.col("sensor_type")
    op = F.when(kind == "signup", "d").when(kind == "view", "r").otherwise("c")
    message = _change(op, kind != "signup")
    damaged = F.concat(F.lit("damaged "), message)
    purchase = F.when(F.col("measurement") >= 20, damaged)  # NULL otherwise: a tombstone
    value = F.when(kind == "purchase", purchase).otherwise(message)
    return readings.select(value.alias("value"))


def _change(op: Column, has_row: Column) -> Column:
    row = F.struct(
        "id",
        "sensor_id",
        "sensor_type",
        "measurement",
        wall_clock_to_micros(F.col("timestamp")).alias("timestamp"),
    )
    payload = F.struct(op.alias("op"), F.when(has_row, row).alias("after"))
    return F.to_json(F.struct(payload.alias("payload")), {"ignoreNullFields": "false"})


def change_messages(readings: DataFrame) -> DataFrame:
    """Every reading as a change of its sensor's row: signups delete it. ``id`` is the log position."""
    deleted = F.col("sensor_type") == "signup"
    key = F.struct("sensor_id")
    row = F.struct(
        "sensor_id",
        "id",
        "sensor_type",
        "measurement",
        wall_clock_to_micros(F.col("timestamp")).alias("timestamp"),
    )
    moment = F.floor(wall_clock_to_micros(F.col("timestamp")) / 1000).alias("ts_ms")
    payload = F.struct(
        F.when(deleted, "d").otherwise("u").alias("op"),
        F.when(deleted, key).alias("before"),
        F.when(~deleted, row).alias("after"),
        F.struct(F.col("id").alias("lsn"), moment).alias("source"),
    )
    message = F.to_json(F.struct(payload.alias("payload")), {"ignoreNullFields": "false"})
    return readings.select(message.alias("value"), "id", "sensor_id")


def changes_out_of_order(readings: DataFrame, parts: int = 4) -> list[DataFrame]:
    """The change messages as they may arrive: in no order, every fifth one a second time later, with
    tombstones and damaged ones among them."""
    messages = change_messages(readings)
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    again = F.pmod(F.xxhash64("id", F.lit("again")), F.lit(5)) == 0
    noise = F.when(F.col("id") % 2 == 0, F.concat(F.lit("damaged "), F.col("value")))
    arriving = []
    for number in range(parts):
        first = messages.where(part == number)
        repeated = messages.where(again & (part == number - 1))
        noisy = messages.where((F.col("id") % 50 == 0) & (part == number)).withColumn("value", noise)
        arriving.append(first.unionByName(repeated).unionByName(noisy).select("value"))
    return arriving


def document_envelopes(readings: DataFrame) -> DataFrame:
    """Change messages of a document store: ``after`` is the document as JSON text."""
    payload = F.struct(F.lit("c").alias("op"), _document().alias("after"))
    message = F.to_json(F.struct(payload.alias("payload")))
    return readings.select(message.alias("value"))


def mixed_document_envelopes(readings: DataFrame) -> DataFrame:
    """Messages of every kind: signups are deletes, views hold a cut document, errors one with a
    number that is none, purchases are tombstones or damaged as a whole."""
    kind = F.col("sensor_type")
    cut = F.expr("substring(document, 1, length(document) - 2)")
    after = (
        F.when(kind == "signup", F.lit(None)).when(kind == "view", cut)
        .when(kind == "error", F.regexp_replace("document", '"sensor_type"', '"measurement":"9O","sensor_type"'))
        .otherwise(F.col("document"))
    )
    op = F.when(kind == "signup", "d").otherwise("c")
    payload = F.struct(op.alias("op"), after.alias("after"))
    message = F.to_json(F.struct(payload.alias("payload")), {"ignoreNullFields": "false"})
    purchase = F.when(F.col("measurement") >= 20, F.concat(F.lit("damaged "), message))
    value = F.when(kind == "purchase", purchase).otherwise(message)
    return readings.withColumn("document", _document()).select(value.alias("value"))


def _document() -> Column:
    return F.to_json(
        F.struct(
            "id",
            "sensor_id",
            "sensor_type",
            "measurement",
            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        )
    )


def damaged_lake(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of lake files, some damaged: CSV rows without their header, and JSON objects.

    Purchases have a letter in their number in the CSV half, signups are cut short in
    the JSON half.
    """
    time = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    number = F.coalesce(F.col("measurement").cast("string"), F.lit(""))
    number = F.when(F.col("sensor_type") == "purchase", F.concat(number, F.lit("O"))).otherwise(number)
    as_csv = F.concat_ws(",", "sensor_type", number, time)
    row = F.to_json(F.struct("sensor_type", "measurement", time.alias("timestamp")))
    cut = F.expr("substring(row, 1, length(row) - 3)")
    as_json = F.when(F.col("sensor_type") == "signup", cut).otherwise(F.col("row"))
    halves = readings.withColumn("row", row)
    return halves.select(as_csv.alias("value")), halves.select(as_json.alias("value"))


def one_line_arrays(readings: DataFrame) -> DataFrame:
    """Arrays of some thousand readings by ``part``, each on a single line of JSON."""
    time = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")
    row = F.to_json(F.struct("sensor_type", "measurement", time), {"ignoreNullFields": "false"})
    parts = readings.select(F.floor(F.col("id") / 4000).alias("part"), row.alias("row"))
    whole = F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]"))
    return parts.groupBy("part").agg(whole.alias("value"))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files in a folder, if there is one."""
    folder, system = _folder(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return [n for n in names if n.startswith("part-")]


def rename_files(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Give the data files of a folder another ending."""
    folder, system = _folder(spark, path)
    make = spark._jvm.org.apache.hadoop.fs.Path
    for name in data_files(spark, path):
        system.rename(make(f"{path}/{name}"), make(f"{path}/{name.removesuffix(old)}{new}"))


def age_files(spark: SparkSession, paths: list[str], age: datetime.timedelta) -> None:
    """Make files look as old as that, as copies with preserved times do."""
    for path in paths:
        file, system = _folder(spark, path)
        now = system.getFileStatus(file).getModificationTime()
        system.setTimes(file, now - int(age.total_seconds() * 1000), -1)
