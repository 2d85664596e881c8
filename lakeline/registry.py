"""Every operator as a query over the test tables: ``name -> f(spark, sf_dir)``.

Results carry zone-less times and means rounded to six digits, so that they
compare equal whatever order the rows were summed in.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline import testviews as V
from lakeline.config import CsvOptions, DocTarget, JobConfig, TableTarget
from lakeline.operators import enrolment
from lakeline.operators.cdc import changed_rows, decode_document_envelopes, decode_envelopes
from lakeline.operators.counting import count_by
from lakeline.operators.current import current_rows, decode_changes, fold_changes, rows_at
from lakeline.operators.dashboard import dashboard_tables
from lakeline.operators.outages import merge_segments, online_segments, outages, sensor_outages
from lakeline.operators.rollup import rollup
from lakeline.operators.rows import drop_second_row
from lakeline.operators.sensors import (
    bucket_means,
    class_counts,
    health_counts,
    last_readings,
    newest,
    online_at,
    sensor_health,
    sensor_metrics,
    sensors_online,
    with_status,
)
from lakeline.operators.smoothing import smooth
from lakeline.plans.compaction import CompactedLake
from lakeline.plans.enrolments import load_students
from lakeline.plans.mail_logins import login_counts, login_events
from lakeline.plans.migration import migrate_readings
from lakeline.plans.payroll import payroll_lines, title_counts
from lakeline.plans.salaries import parse_salaries, top_salaries
from lakeline.plans.sensor_lake import lake_metrics, refresh, start_lake_updates
from lakeline.plans.verification import copy_in_parts, differences, read_parts
from lakeline.schemas import READING, lake_schema
from lakeline.session import scratch_path
from lakeline.sinks import (
    migrate,
    read_days,
    read_version,
    save,
    write_docs,
    write_lake_csv,
    write_lake_json,
    write_metrics,
    write_tsv,
)
from lakeline.sources import (
    column_types,
    infer_schema,
    profile_csv,
    read_csv,
    read_docs,
    read_envelope_files,
    read_json_readings,
    read_key_values,
    read_lake_rejects,
    read_lines,
    read_sensor_csv,
    read_sensor_json,
    read_sensor_lake,
    read_target,
    type_changes,
)
from lakeline.streaming import (
    latest_state,
    open_buckets,
    read_current,
    run_to_end,
    start_closed_buckets,
    start_current_table,
    start_dashboard,
    start_json_sink,
    start_keyed_state,
    start_running_metrics,
    windowed_means,
)
from lakeline.streaming.jobs import DRAIN

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Parameters of the queries; the oracle uses the same values.
LOGIN_THRESHOLD = 15
ADMISSION = "1-URGENT"
SEX = "F"
COURSE = "CURSO_7"
AS_OF = datetime.datetime(2024, 1, 15, 12, 30)
YEAR_1997 = enrolment.Period(datetime.date(1997, 1, 1), datetime.date(1998, 1, 1))

SENSOR_DOC = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("sensor_type", T.StringType()),
        T.StructField("measurement", T.DoubleType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)
ENVELOPE_KEYS = (SENSOR_DOC["id"], SENSOR_DOC["sensor_id"])


def query(name: str) -> Callable[[Query], Query]:
    """Register a query. The tables hold UTC wall clocks, so the session reads them as UTC."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[name] = run
        return run

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "orders")


def _sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sensors(_events(spark, sf_dir))


def _sensor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.instants(V.sensors(V.streamed(spark, sf_dir, "events")))


def _sensor_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as a stream of four micro-batches, in order of time."""
    path = scratch_path(spark, "readings")
    readings = V.instants(_sensors(spark, sf_dir))
    for first, last in ((1, 8), (9, 16), (17, 24), (25, 31)):
        part = readings.where(F.dayofmonth("timestamp").between(first, last))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.students(_orders(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round in two steps: the first removes the noise of the summation order, so that a
    mean that lies exactly between two results of the second goes the same way every time."""
    return df.withColumns({c: F.round(F.round(c, 9), 6) for c in columns})


def _rounded_metrics(metrics: DataFrame) -> DataFrame:
    return _rounded(metrics, "average_measurement", "average_valid")


# --- text: mail log, salary list, payroll -----------------------------------


@query("login_events")
def _(spark, sf_dir):
    good, _rejected = login_events(V.mail_log(_events(spark, sf_dir)))
    return good


@query("login_rejects")
def _(spark, sf_dir):
    _good, rejected = login_events(V.mail_log(_events(spark, sf_dir), nameless="view"))
    return rejected


@query("login_counts")
def _(spark, sf_dir):
    return login_counts(V.mail_log(_events(spark, sf_dir)), LOGIN_THRESHOLD)


@query("login_counts_tsv")
def _(spark, sf_dir):
    path = scratch_path(spark, "logins")
    write_tsv(login_counts(V.mail_log(_events(spark, sf_dir)), LOGIN_THRESHOLD), path)
    pairs = read_key_values(spark, path)
    return pairs.select(F.col("key").alias("username"), F.col("value").try_cast("bigint").alias("n"))


@query("salary_parse")
def _(spark, sf_dir):
    good, _rejected = parse_salaries(V.salaries(V.table(spark, sf_dir, "customer")))
    return good


@query("salary_rejects")
def _(spark, sf_dir):
    lines = V.salaries(V.table(spark, sf_dir, "customer"), V.bracketed_debts())
    _good, rejected = parse_salaries(lines)
    return rejected


@query("salary_top6")
def _(spark, sf_dir):
    return top_salaries(V.salaries(V.table(spark, sf_dir, "customer")))


@query("line_scan")
def _(spark, sf_dir):
    path = scratch_path(spark, "lines")
    V.salaries(V.table(spark, sf_dir, "customer")).write.text(path)
    good, _rejected = parse_salaries(read_lines(spark, path))
    return good


@query("title_counts")
def _(spark, sf_dir):
    return title_counts(V.payroll(_orders(spark, sf_dir)))


@query("title_counts_skip")
def _(spark, sf_dir):
    return title_counts(drop_second_row(V.payroll(_orders(spark, sf_dir)), "position"))


@query("title_counts_file")
def _(spark, sf_dir):
    path = scratch_path(spark, "payroll")
    V.payroll(_orders(spark, sf_dir)).orderBy("position").select("value").write.text(path)
    return title_counts(payroll_lines(spark, path))


# --- enrolment --------------------------------------------------------------


def _matching(spark, sf_dir, **conditions):
    return enrolment.matching(_students(spark, sf_dir), columns=V.STUDENT_COLUMNS, **conditions)


@query("enrol_by_admission")
def _(spark, sf_dir):
    return _matching(spark, sf_dir, admission=ADMISSION)


@query("enrol_by_admission_sex")
def _(spark, sf_dir):
    return _matching(spark, sf_dir, admission=ADMISSION, sex=SEX)


@query("enrol_sex_counts")
def _(spark, sf_dir):
    return enrolment.sex_counts(_students(spark, sf_dir), V.STUDENT_COLUMNS)


@query("enrol_top5_courses")
def _(spark, sf_dir):
    return enrolment.top_courses(_students(spark, sf_dir), 5, V.STUDENT_COLUMNS)


@query("enrol_count_in_period")
def _(spark, sf_dir):
    return enrolment.how_many(_matching(spark, sf_dir, admission=ADMISSION, period=YEAR_1997))


@query("enrol_age_distribution")
def _(spark, sf_dir):
    return enrolment.age_distribution(
        _matching(spark, sf_dir, admission=ADMISSION), V.STUDENT_COLUMNS
    )


@query("enrol_count_in_course")
def _(spark, sf_dir):
    return enrolment.how_many(_matching(spark, sf_dir, admission=ADMISSION, course=COURSE))


@query("enrol_sex_by_admission")
def _(spark, sf_dir):
    return enrolment.sex_counts(_matching(spark, sf_dir, admission=ADMISSION), V.STUDENT_COLUMNS)


@query("enrol_top5_by_admission")
def _(spark, sf_dir):
    return enrolment.top_courses(
        _matching(spark, sf_dir, admission=ADMISSION), 5, V.STUDENT_COLUMNS
    )


@query("enrol_top5_in_period")
def _(spark, sf_dir):
    chosen = _matching(spark, sf_dir, admission=ADMISSION, period=YEAR_1997)
    return enrolment.top_courses(chosen, 5, V.STUDENT_COLUMNS)


@query("enrol_job")
def _(spark, sf_dir):
    """The whole job: a CSV file of students, then what every collection holds, as text."""
    base = scratch_path(spark, "enrolment")
    students = _students(spark, sf_dir)
    students.write.option("header", True).option("sep", ";").csv(f"{base}/input")
    results = load_students(
        spark,
        JobConfig(input_path=f"{base}/input", collection="students"),
        lambda name: DocTarget.json_files(f"{base}/{name or 'students'}"),
        admission=ADMISSION,
        sex=SEX,
        columns=V.STUDENT_COLUMNS,
        questions={"admission": ADMISSION, "course": COURSE, "period": YEAR_1997},
    )
    held = None
    for name, frame in {"students": students, **results}.items():
        saved = read_docs(spark, DocTarget.json_files(f"{base}/{name}", frame.schema))
        # Whole students are told by their id and its fields, summaries by group and count.
        fields = [c for c in ("id", "admission", "sex", "course", "age", "count", "n") if c in saved.columns]
        told = F.concat_ws("|", *[F.col(c).cast("string") for c in fields])
        rows = saved.select(F.lit(name).alias("collection"), told.alias("row"))
        held = rows if held is None else held.unionByName(rows)
    return held


# --- change data capture ----------------------------------------------------


@query("cdc_decode")
def _(spark, sf_dir):
    messages = V.envelopes(_sensors(spark, sf_dir))
    return V.wall_clock(decode_envelopes(messages, extra=ENVELOPE_KEYS), "timestamp")


@query("cdc_decode_micros")
def _(spark, sf_dir):
    messages = V.envelopes(_sensors(spark, sf_dir))
    decoded = decode_envelopes(
        messages, measurement_type="double", precision="micro", extra=ENVELOPE_KEYS
    )
    return V.wall_clock(changed_rows(decoded), "timestamp").select(SENSOR_DOC.fieldNames())


@query("cdc_metrics")
def _(spark, sf_dir):
    messages = V.envelopes(_sensors(spark, sf_dir))
    return _rounded_metrics(sensor_metrics(decode_envelopes(messages)))


@query("cdc_changes")
def _(spark, sf_dir):
    decoded = decode_envelopes(V.mixed_envelopes(_sensors(spark, sf_dir)))
    return count_by(decoded, "op", "has_row")


@query("cdc_changes_metrics")
def _(spark, sf_dir):
    decoded = decode_envelopes(V.mixed_envelopes(_sensors(spark, sf_dir)))
    return _rounded_metrics(sensor_metrics(decoded))


@query("cdc_docs_decode")
def _(spark, sf_dir):
    messages = V.document_envelopes(_sensors(spark, sf_dir))
    return V.wall_clock(decode_document_envelopes(messages, extra=ENVELOPE_KEYS), "timestamp")


@query("cdc_docs_changes")
def _(spark, sf_dir):
    messages = V.mixed_document_envelopes(_sensors(spark, sf_dir))
    decoded = decode_document_envelopes(messages, extra=ENVELOPE_KEYS)
    return decoded.groupBy("op", "has_row").agg(
        F.count("*").alias("n"), F.count("id").alias("n_id"), F.count("measurement").alias("n_measured")
    )


# --- sensors ----------------------------------------------------------------


@query("sensor_metrics")
def _(spark, sf_dir):
    return _rounded_metrics(sensor_metrics(_sensors(spark, sf_dir)))


@query("sensor_classes")
def _(spark, sf_dir):
    return class_counts(_sensors(spark, sf_dir))


@query("sensor_health")
def _(spark, sf_dir):
    health = sensor_health(_sensors(spark, sf_dir), ["sensor_id", "sensor_type"])
    return _rounded(health, "average_valid", "valid_ratio")


@query("sensor_buckets")
def _(spark, sf_dir):
    means = bucket_means(_sensors(spark, sf_dir), ["sensor_type"])
    return _rounded_metrics(means)


@query("sensor_smoothing")
def _(spark, sf_dir):
    means = bucket_means(_sensors(spark, sf_dir), ["sensor_type"])
    smoothed = smooth(means, ["sensor_type"])
    return _rounded(smoothed, "smoothed").select("sensor_type", "bucket", "smoothed")


@query("sensor_online")
def _(spark, sf_dir):
    return sensors_online(_sensors(spark, sf_dir), ["sensor_id"])


@query("sensor_online_as_of")
def _(spark, sf_dir):
    return sensors_online(_sensors(spark, sf_dir), ["sensor_id"], AS_OF)


# --- lake files, stores, migrations -----------------------------------------


def _readings(spark, sf_dir):
    return _sensors(spark, sf_dir).select("sensor_type", "measurement", "timestamp")


def _lake_halves(spark, sf_dir):
    """Some sensors send CSV files to the lake, the others JSON files."""
    readings = _readings(spark, sf_dir)
    sends_csv = F.col("sensor_type").isin("click", "view", "error")
    return readings.where(sends_csv), readings.where(~sends_csv)


def _write_lake(spark, sf_dir):
    path = scratch_path(spark, "lake")
    as_csv, as_json = _lake_halves(spark, sf_dir)
    write_lake_csv(as_csv, path)
    write_lake_json(as_json, path)
    return path


@query("sensor_outages")
def _(spark, sf_dir):
    return sensor_outages(_sensors(spark, sf_dir), ["sensor_id"])


@query("sensor_outages_merged")
def _(spark, sf_dir):
    """The same from stored segments of parts of the readings, dealt without regard to time."""
    path, keys = scratch_path(spark, "segments"), ["sensor_id"]
    readings = _sensors(spark, sf_dir)
    for part in range(3):
        own = readings.where(F.pmod("id", F.lit(3)) == part)
        online_segments(own, keys).write.mode("append").parquet(path)
    merged = merge_segments(spark.read.parquet(path), keys)
    return outages(merged, keys, newest(merged, "ended"))


@query("ingest_csv")
def _(spark, sf_dir):
    path = scratch_path(spark, "lake-csv")
    write_lake_csv(_readings(spark, sf_dir), path)
    return V.wall_clock(read_sensor_csv(spark, path), "timestamp")


@query("ingest_csv_inferred")
def _(spark, sf_dir):
    path = scratch_path(spark, "students-csv")
    students = _students(spark, sf_dir).select("id", "admission", "sex", "course", "birth_year")
    students.write.option("header", True).option("sep", ";").csv(path)
    loaded = read_csv(spark, path)
    return loaded.withColumns({c: F.col(c).cast("bigint") for c in ("id", "birth_year")})


def _order_files(spark, sf_dir):
    """Orders as CSV, a folder a year; in the last one customers are no numbers any more."""
    path = scratch_path(spark, "orders-csv")
    year = F.year("o_orderdate")
    customer = F.col("o_custkey").cast("string")
    placed = _orders(spark, sf_dir).select(
        "o_orderkey",
        F.when(year == 1998, F.concat(F.lit("C-"), customer)).otherwise(customer).alias("customer"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.col("o_orderdate").cast("date").alias("placed"),
        "o_orderstatus",
        year.alias("year"),
    )
    # Dealt by key first: a writer sorts its rows by year, so no task may hold a growing share.
    placed.repartition("o_orderkey").write.partitionBy("year").option("header", True).option(
        "sep", ";"
    ).csv(path)
    return f"{path}/*"


@query("ingest_csv_types")
def _(spark, sf_dir):
    """Types of all columns, and the year whose files changed one."""
    profile = profile_csv(spark, _order_files(spark, sf_dir))
    changes = type_changes(profile).select(
        "position", "before", F.regexp_extract("file", "year=([0-9]+)", 1).cast("int").alias("changed_in")
    )
    return column_types(profile).join(changes, "position", "left").drop("position")


@query("ingest_csv_by_profile")
def _(spark, sf_dir):
    """Read with the types that the profile found."""
    path = _order_files(spark, sf_dir)
    found = infer_schema(profile_csv(spark, path))
    loaded = read_csv(spark, path, CsvOptions(schema=found))
    return loaded.withColumns(
        {"o_orderkey": F.col("o_orderkey").cast("bigint"), "price": F.round("price", 2)}
    )


@query("lake_compacted")
def _(spark, sf_dir):
    """A lake gathered in three runs, two of them merged, and files that came later."""
    base = scratch_path(spark, "compaction")
    readings = _readings(spark, sf_dir)
    compacted = CompactedLake(spark, f"{base}/*", f"{base}-runs", fold=2)
    for part in range(4):
        rows = readings.where(F.pmod(F.xxhash64(*readings.columns), F.lit(4)) == part)
        write_lake_csv(rows.where("measurement IS NULL"), f"{base}/{part}")
        write_lake_json(rows.where("measurement IS NOT NULL"), f"{base}/{part}")
        if part < 3:
            compacted.compact()
    return V.wall_clock(compacted.read(), "timestamp")


@query("ingest_json")
def _(spark, sf_dir):
    path = scratch_path(spark, "lake-json")
    write_lake_json(_readings(spark, sf_dir), path)
    return V.wall_clock(read_sensor_json(spark, path), "timestamp")


@query("ingest_json_arrays")
def _(spark, sf_dir):
    """Files of a single line, each of which Spark splits between tasks."""
    path = scratch_path(spark, "json-arrays")
    V.one_line_arrays(_sensors(spark, sf_dir)).write.partitionBy("part").text(path)
    return V.wall_clock(read_json_readings(spark, f"{path}/*", glob="*.txt"), "timestamp")


@query("ingest_lake")
def _(spark, sf_dir):
    return V.wall_clock(read_sensor_lake(spark, _write_lake(spark, sf_dir)), "timestamp")


@query("lake_rejects")
def _(spark, sf_dir):
    """A lake with damaged lines: readings and rejects of each kind of sensor."""
    path = scratch_path(spark, "lake")
    as_csv, as_json = V.damaged_lake(_readings(spark, sf_dir))
    # Every part file needs a header of its own.
    header = spark.range(1).select(F.lit(",".join(READING.names)).alias("value"))
    header.unionByName(as_csv).coalesce(1).write.text(f"{path}/csv")
    as_json.write.text(f"{path}/json")
    V.rename_files(spark, f"{path}/csv", ".txt", ".csv")
    V.rename_files(spark, f"{path}/json", ".txt", ".json")
    kept = read_sensor_lake(spark, f"{path}/*").select("sensor_type", F.lit("reading").alias("kind"))
    lost = read_lake_rejects(spark, f"{path}/*")
    cut = F.regexp_extract("value", r'^(?:\{"sensor_type":")?([a-z_]+)', 1)
    rejected = lost.select(cut.alias("sensor_type"), F.lit("reject").alias("kind"))
    return count_by(kept.unionByName(rejected), "sensor_type", "kind")


def _dashboard(spark, sf_dir, name, **options):
    """Read the lake once, save one dashboard table to both stores, and show both copies."""
    metrics = lake_metrics(spark, _write_lake(spark, sf_dir), **options)
    base = scratch_path(spark, "dashboard")
    docs = DocTarget.json_files(f"{base}/docs", metrics[name].schema)
    rows = TableTarget.parquet_files(f"{base}/table")
    refresh(metrics, {name: [docs, rows]})
    return _both(read_docs(spark, docs), read_target(spark, rows))


def _both(documents, rows):
    return documents.withColumn("target", F.lit("documents")).unionByName(
        rows.withColumn("target", F.lit("table"))
    )


@query("lake_metrics")
def _(spark, sf_dir):
    return _rounded_metrics(_dashboard(spark, sf_dir, "sensor_metrics"))


@query("lake_health")
def _(spark, sf_dir):
    health = _dashboard(spark, sf_dir, "sensor_health")
    return V.wall_clock(_rounded(health, "average_valid", "valid_ratio"), "last_seen")


@query("lake_buckets")
def _(spark, sf_dir):
    means = _dashboard(spark, sf_dir, "sensor_buckets")
    return V.wall_clock(_rounded_metrics(means), "bucket")


@query("lake_smoothing")
def _(spark, sf_dir):
    smoothed = _dashboard(spark, sf_dir, "sensor_smoothing")
    wanted = _rounded(smoothed, "smoothed").select("sensor_type", "bucket", "smoothed", "target")
    return V.wall_clock(wanted, "bucket")


@query("lake_online")
def _(spark, sf_dir):
    online = _dashboard(spark, sf_dir, "sensors_online", repeatable=True)
    return V.wall_clock(online, "last_seen")


@query("lake_online_as_of")
def _(spark, sf_dir):
    online = _dashboard(spark, sf_dir, "sensors_online", as_of=AS_OF, repeatable=True)
    return V.wall_clock(online, "last_seen")


@query("lake_health_as_of")
def _(spark, sf_dir):
    health = _dashboard(spark, sf_dir, "sensor_health", as_of=AS_OF)
    return V.wall_clock(_rounded(health, "average_valid", "valid_ratio"), "last_seen")


def _keyed_dashboard(spark, sf_dir, name, **options):
    """The same from files that begin with the sensor's id."""
    path = scratch_path(spark, "keyed-lake")
    keys, schema = ["sensor_id", "sensor_type"], lake_schema(["sensor_id"])
    write_lake_csv(_sensors(spark, sf_dir).select(schema.names), path)
    return lake_metrics(spark, path, keys, schema=schema, **options)[name]


@query("lake_sensor_health")
def _(spark, sf_dir):
    health = _keyed_dashboard(spark, sf_dir, "sensor_health")
    return V.wall_clock(_rounded(health, "average_valid", "valid_ratio"), "last_seen")


@query("lake_sensor_online")
def _(spark, sf_dir):
    online = _keyed_dashboard(spark, sf_dir, "sensors_online", repeatable=True)
    return V.wall_clock(online, "last_seen")


@query("docs_roundtrip")
def _(spark, sf_dir):
    target = DocTarget.json_files(scratch_path(spark, "docs"), SENSOR_DOC)
    write_docs(_sensors(spark, sf_dir), target)
    return read_docs(spark, target)


@query("docs_append")
def _(spark, sf_dir):
    """Bulk inserts: one per kind of sensor into the same collection."""
    target = DocTarget.json_files(scratch_path(spark, "docs"), SENSOR_DOC)
    readings = _sensors(spark, sf_dir)
    burnt_out = F.col("sensor_type") == "error"
    write_docs(readings.where(burnt_out), target, "append")
    write_docs(readings.where(~burnt_out), target, "append")
    return read_docs(spark, target)


@query("table_roundtrip")
def _(spark, sf_dir):
    target = TableTarget.parquet_files(scratch_path(spark, "table"))
    save(_sensors(spark, sf_dir), target, "append")
    return read_target(spark, target)


@query("migrate_table_to_docs")
def _(spark, sf_dir):
    source = TableTarget.parquet_files(scratch_path(spark, "table"))
    target = DocTarget.json_files(scratch_path(spark, "docs"), SENSOR_DOC)
    save(_sensors(spark, sf_dir), source)
    migrate(spark, source, target)
    return read_docs(spark, target)


@query("migrate_docs_to_table")
def _(spark, sf_dir):
    source = DocTarget.json_files(scratch_path(spark, "docs"), SENSOR_DOC)
    target = TableTarget.parquet_files(scratch_path(spark, "table"))
    write_docs(_sensors(spark, sf_dir), source)
    migrate(spark, source, target)
    return read_target(spark, target)


@query("migrate_metrics")
def _(spark, sf_dir):
    """The metrics a migration saves to both stores while it copies."""
    base = scratch_path(spark, "migration")
    source = TableTarget.parquet_files(f"{base}/table")
    save(_sensors(spark, sf_dir), source)
    rows = TableTarget.parquet_files(f"{base}/metrics-table")
    docs = DocTarget.json_files(f"{base}/metrics-docs")
    metrics = migrate_readings(
        spark, source, DocTarget.json_files(f"{base}/docs"), [docs, rows]
    )
    return _rounded_metrics(
        _both(
            read_docs(spark, DocTarget(docs.format, docs.options, metrics.schema)),
            read_target(spark, rows),
        )
    )


@query("migrate_verify")
def _(spark, sf_dir):
    """A copy in another format that lost a row, holds one twice and changed one."""
    base = scratch_path(spark, "verify")
    source = TableTarget.parquet_files(f"{base}/table")
    target = DocTarget.json_files(f"{base}/docs", SENSOR_DOC)
    readings = _sensors(spark, sf_dir)
    save(readings, source)
    first, last = readings.agg(F.min("id"), F.max("id")).first()
    middle = readings.where(F.col("id") * 2 <= last).agg(F.max("id")).scalar()
    value = F.when(F.col("id") == middle, F.coalesce("measurement", F.lit(0.0)) + 1).otherwise(F.col("measurement"))
    copied = readings.where(F.col("id") != first).withColumn("measurement", value)
    write_docs(copied.unionByName(readings.where(F.col("id") == last)), target)
    return differences(read_target(spark, source), read_docs(spark, target), "id", fanout=16, leaf=500)


@query("migrate_resumed")
def _(spark, sf_dir):
    """A copy in ranges that was broken half way, within a range, and went on."""
    base = scratch_path(spark, "resumed")
    source = TableTarget.parquet_files(f"{base}/table")
    target = DocTarget.json_files(f"{base}/docs", SENSOR_DOC)
    save(_sensors(spark, sf_dir), source)
    if copy_in_parts(spark, source, target, "id", f"{base}/manifest", parts=6, at_most=3) != 3:
        raise RuntimeError("the first run copies three ranges")
    broken = read_target(spark, source).where(F.col("id") % 2 == 0)
    broken.write.format("json").options(**target.named("part=3").options).save()
    if copy_in_parts(spark, source, target, "id", f"{base}/manifest", parts=6) > 4:
        raise RuntimeError("the second run copies what the first one left")
    return read_parts(spark, target)


@query("metrics_dual_sink")
def _(spark, sf_dir):
    metrics = sensor_metrics(_sensors(spark, sf_dir))
    docs = DocTarget.json_files(scratch_path(spark, "metrics-docs"), metrics.schema)
    rows = TableTarget.parquet_files(scratch_path(spark, "metrics-table"))
    write_metrics(metrics, [docs, rows])
    return _rounded_metrics(_both(read_docs(spark, docs), read_target(spark, rows)))


# --- current tables from changes ---------------------------------------------

#: Files of a micro-batch of the streams below.
FILES_A_BATCH = 4
CHANGE_KEY = (SENSOR_DOC["sensor_id"],)


def _changes(messages):
    return decode_changes(
        messages, CHANGE_KEY, measurement_type="double", precision="micro", extra=ENVELOPE_KEYS[:1]
    )


def _current(rows):
    return V.wall_clock(rows.select(SENSOR_DOC.names), "timestamp")


@query("cdc_fold")
def _(spark, sf_dir):
    """The current table from all changes at once."""
    messages = V.change_messages(_sensors(spark, sf_dir))
    return _current(current_rows(fold_changes(_changes(messages), ["sensor_id"])))


@query("cdc_rows_at")
def _(spark, sf_dir):
    """The table as it was when half of the log was written."""
    readings = _sensors(spark, sf_dir)
    half = F.struct(readings.agg(F.floor(F.max("id") / 2)).scalar().alias("lsn"))
    return _current(rows_at(_changes(V.change_messages(readings)), ["sensor_id"], half))


@query("cdc_current_table")
def _(spark, sf_dir):
    """The same kept by a stream, whose messages come late and more than once."""
    topic, base = scratch_path(spark, "changes"), scratch_path(spark, "current")
    for part in V.changes_out_of_order(_sensors(spark, sf_dir)):
        part.repartition(FILES_A_BATCH).write.mode("append").json(topic)
    messages = read_envelope_files(spark, topic, maxFilesPerTrigger=str(FILES_A_BATCH))
    query = start_current_table(
        _changes(messages), ["sensor_id"], f"{base}/rows", f"{base}/checkpoint", DRAIN, fold=2
    )
    run_to_end(query)
    _ran_several(query)
    return _current(read_current(spark, f"{base}/rows", ["sensor_id"]))


# --- streams ----------------------------------------------------------------


@query("stream_cdc_metrics")
def _(spark, sf_dir):
    """Messages arrive as files; the cumulative metrics of the last micro-batch are shown."""
    topic = scratch_path(spark, "topic")
    V.envelopes(_sensors(spark, sf_dir)).write.json(topic)
    files = len(V.data_files(spark, topic))
    per_batch = str(max(1, math.ceil(files / 4)))
    messages = read_envelope_files(spark, topic, maxFilesPerTrigger=per_batch)
    base = scratch_path(spark, "running-metrics")
    docs = DocTarget.json_files(f"{base}/docs")
    rows = TableTarget.parquet_files(f"{base}/table")
    run_to_end(
        start_running_metrics(
            decode_envelopes(messages), [docs, rows], f"{base}/checkpoint", DRAIN
        )
    )
    newest_first = read_target(spark, rows).orderBy(F.desc("batch_id")).limit(1)
    return _rounded_metrics(newest_first.drop("batch_id"))


EIGHT_DAYS = datetime.timedelta(days=8)


def _updated(spark, sf_dir, name):
    """Files arrive three times, the last ones with old times; each run reads the new ones only.

    Shows a dashboard table from both stores, after checks that every run read its
    own files and no others.
    """
    lake, base = scratch_path(spark, "lake"), scratch_path(spark, "lake-updates")
    targets = _dashboard_stores(base, name)
    as_csv, as_json = _lake_halves(spark, sf_dir)
    early = F.dayofmonth("timestamp") <= 10
    arrivals = [
        (write_lake_csv, as_csv.where(early), None),
        (write_lake_json, as_json, None),
        (write_lake_csv, as_csv.where(~early), EIGHT_DAYS),
    ]
    for write, arriving, age in arrivals:
        arrived = set(V.data_files(spark, lake))
        write(arriving, lake)
        if age is not None:
            new = [f for f in V.data_files(spark, lake) if f not in arrived]
            V.age_files(spark, [f"{lake}/{f}" for f in new], age)
        update = start_lake_updates(spark, lake, targets, f"{base}/checkpoint", fold=2)
        run_to_end(update)
        read = sum(p.numInputRows for p in update.recentProgress)
        if read != arriving.count():
            raise RuntimeError(f"read {read} rows of {arriving.count()} that arrived")
    return _both_versions(spark, targets[name], lake_metrics(spark, lake)[name].schema)


def _dashboard_stores(base, name):
    docs, rows = DocTarget.json_files(f"{base}/docs"), TableTarget.parquet_files(f"{base}/table")
    return {name: [docs.named(name), rows.named(name)]}


def _both_versions(spark, stores, schema):
    docs, rows = stores
    docs = DocTarget(docs.format, docs.options, schema)
    read = read_days if "bucket" in schema.names else read_version
    return _both(read(spark, docs), read(spark, rows))


def _shown(table, name):
    """A dashboard table in the form its SQL gives."""
    if name == "sensor_metrics":
        return _rounded_metrics(table)
    if name == "sensor_health":
        return V.wall_clock(_rounded(table, "average_valid", "valid_ratio"), "last_seen")
    if name == "sensor_buckets":
        return V.wall_clock(_rounded_metrics(table), "bucket")
    if name == "sensor_smoothing":
        smoothed = _rounded(table, "smoothed").select("sensor_type", "bucket", "smoothed", "target")
        return V.wall_clock(smoothed, "bucket")
    # No two readings of a kind share its last instant in the test tables.
    return V.wall_clock(table, "last_seen")


@query("stream_lake_metrics")
def _(spark, sf_dir):
    return _shown(_updated(spark, sf_dir, "sensor_metrics"), "sensor_metrics")


@query("stream_lake_health")
def _(spark, sf_dir):
    return _shown(_updated(spark, sf_dir, "sensor_health"), "sensor_health")


@query("stream_lake_buckets")
def _(spark, sf_dir):
    return _shown(_updated(spark, sf_dir, "sensor_buckets"), "sensor_buckets")


@query("stream_lake_smoothing")
def _(spark, sf_dir):
    return _shown(_updated(spark, sf_dir, "sensor_smoothing"), "sensor_smoothing")


@query("stream_lake_online")
def _(spark, sf_dir):
    return _shown(_updated(spark, sf_dir, "sensors_online"), "sensors_online")


def _late_topic(readings, topic):
    """Messages of four micro-batches, in order of time but for every seventh reading: those come last."""
    late = F.col("id") % 7 == 0
    for first, last in ((1, 12), (13, 22), (23, 31)):
        part = readings.where(~late & F.dayofmonth("timestamp").between(first, last))
        V.envelopes(part).repartition(FILES_A_BATCH).write.mode("append").json(topic)
    V.envelopes(readings.where(late)).repartition(FILES_A_BATCH).write.mode("append").json(topic)


def _live(spark, sf_dir, name):
    """The dashboard kept from a topic, in several micro-batches, from both stores.

    The readings arrive in order of time, but for every seventh: those come last, late.
    """
    topic, base = scratch_path(spark, "topic"), scratch_path(spark, "live")
    _late_topic(_sensors(spark, sf_dir), topic)
    messages = read_envelope_files(spark, topic, maxFilesPerTrigger=str(FILES_A_BATCH))
    decoded = decode_envelopes(messages, measurement_type="double", precision="micro").where("has_row")
    targets = _dashboard_stores(base, name)
    query = start_dashboard(decoded, targets, f"{base}/checkpoint", trigger=DRAIN, fold=3)
    run_to_end(query)
    _ran_several(query)
    schema = dashboard_tables(rollup(_readings_as_instants(spark, sf_dir), ["sensor_type"]), ["sensor_type"])
    return _both_versions(spark, targets[name], schema[name].schema)


def _readings_as_instants(spark, sf_dir):
    return V.instants(_readings(spark, sf_dir))


def _several_files(rows, path):
    """Four files, one after the other in order of time, as JSON lines."""
    for part in range(4):
        rows.where(F.pmod(F.xxhash64("value"), F.lit(4)) == part).coalesce(1).write.mode("append").json(path)


def _ran_several(query):
    batches = [p for p in query.recentProgress if p.numInputRows]
    if len(batches) < 2:
        raise RuntimeError(f"the stream ran as {len(batches)} micro-batch")


@query("stream_late_rows")
def _(spark, sf_dir):
    """Every reading: in a closed bucket, in one that is open, or among the late ones."""
    topic, base = scratch_path(spark, "topic"), scratch_path(spark, "late")
    _late_topic(_sensors(spark, sf_dir), topic)
    messages = read_envelope_files(spark, topic, maxFilesPerTrigger=str(FILES_A_BATCH))
    readings = decode_envelopes(messages, measurement_type="double", precision="micro").where("has_row")
    closed, late = (TableTarget.parquet_files(f"{base}/{name}") for name in ("closed", "late"))
    keys = ["sensor_type"]
    query = start_closed_buckets(readings, keys, [closed], [late], f"{base}/checkpoint", trigger=DRAIN)
    run_to_end(query)
    _ran_several(query)
    means = read_target(spark, closed).select(*keys, "bucket", "n", F.lit("closed").alias("kind"))
    still = open_buckets(spark, f"{base}/checkpoint", keys)
    means = means.unionByName(still.select(*keys, "bucket", "n", F.lit("open").alias("kind")))
    hour = F.date_trunc("hour", "timestamp").alias("bucket")
    lost = read_target(spark, late).groupBy(*keys, hour).agg(F.count("*").alias("n"))
    return V.wall_clock(means.unionByName(lost.withColumn("kind", F.lit("late"))), "bucket")


@query("live_metrics")
def _(spark, sf_dir):
    return _shown(_live(spark, sf_dir, "sensor_metrics"), "sensor_metrics")


@query("live_health")
def _(spark, sf_dir):
    return _shown(_live(spark, sf_dir, "sensor_health"), "sensor_health")


@query("live_buckets")
def _(spark, sf_dir):
    return _shown(_live(spark, sf_dir, "sensor_buckets"), "sensor_buckets")


@query("live_smoothing")
def _(spark, sf_dir):
    return _shown(_live(spark, sf_dir, "sensor_smoothing"), "sensor_smoothing")


@query("live_online")
def _(spark, sf_dir):
    return _shown(_live(spark, sf_dir, "sensors_online"), "sensors_online")


@query("stream_json_sink")
def _(spark, sf_dir):
    base = scratch_path(spark, "json-sink")
    readings = _sensor_stream(spark, sf_dir)
    run_to_end(start_json_sink(readings, f"{base}/out", f"{base}/checkpoint", DRAIN))
    saved = spark.read.schema(readings.schema).json(f"{base}/out")
    return V.wall_clock(saved, "timestamp")


@query("stream_docs_decode")
def _(spark, sf_dir):
    base = scratch_path(spark, "docs-decode")
    messages = V.document_envelopes(_sensor_stream(spark, sf_dir))
    decoded = decode_document_envelopes(messages, extra=ENVELOPE_KEYS)
    run_to_end(start_json_sink(decoded, f"{base}/out", f"{base}/checkpoint", DRAIN))
    saved = spark.read.schema(decoded.schema).json(f"{base}/out")
    return V.wall_clock(saved, "timestamp")


def _closed_buckets(spark, sf_dir):
    base = scratch_path(spark, "buckets")
    means = windowed_means(_sensor_parts(spark, sf_dir), ["sensor_type"])
    query = start_json_sink(means, f"{base}/out", f"{base}/checkpoint", DRAIN)
    run_to_end(query)
    _ran_several(query)
    return V.wall_clock(spark.read.schema(means.schema).json(f"{base}/out"), "bucket")


@query("stream_buckets")
def _(spark, sf_dir):
    return _rounded_metrics(_closed_buckets(spark, sf_dir))


@query("stream_smoothing")
def _(spark, sf_dir):
    smoothed = smooth(_closed_buckets(spark, sf_dir), ["sensor_type"])
    return _rounded(smoothed, "smoothed").select("sensor_type", "bucket", "smoothed")


def _state_of(spark, aggregated, keys, label):
    """Run a keyed aggregate to the end of its stream and read the state it left in the table."""
    base = scratch_path(spark, label)
    docs = DocTarget.json_files(f"{base}/docs")
    rows = TableTarget.parquet_files(f"{base}/table")
    query = start_keyed_state(aggregated, keys, [docs, rows], f"{base}/checkpoint", DRAIN)
    run_to_end(query)
    _ran_several(query)
    return V.wall_clock(latest_state(read_target(spark, rows), keys), "last_seen")


@query("stream_online")
def _(spark, sf_dir):
    keys = ["sensor_id"]
    state = _state_of(spark, last_readings(_sensor_parts(spark, sf_dir), keys), keys, "online")
    return online_at(state, newest(state, "last_seen"))


@query("stream_health")
def _(spark, sf_dir):
    keys = ["sensor_id", "sensor_type"]
    state = _state_of(spark, health_counts(_sensor_parts(spark, sf_dir), keys), keys, "health")
    return _rounded(with_status(state, newest(state, "last_seen")), "average_valid", "valid_ratio")
