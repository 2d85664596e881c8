"""Run a job: ``spark-submit lakeline/__main__.py JOB ...`` or ``python -m lakeline JOB ...``.

Stores are described in files (JSON or YAML with ``format`` and ``options``), so
that no password appears on the command line.
"""

from __future__ import annotations

import argparse
import datetime
import sys
from collections.abc import Sequence
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql.types import StructType  # noqa: E402

from lakeline.config import DocTarget, JobConfig, TableTarget, Target  # noqa: E402
from lakeline.operators.cdc import decode_document_envelopes, decode_envelopes  # noqa: E402
from lakeline.plans import mail_logins, salaries  # noqa: E402
from lakeline.plans.enrolments import load_students  # noqa: E402
from lakeline.plans.migration import migrate_readings  # noqa: E402
from lakeline.operators.dashboard import TABLES  # noqa: E402
from lakeline.operators.enrolment import Period  # noqa: E402
from lakeline.plans.payroll import payroll_lines, title_counts, title_of  # noqa: E402
from lakeline.plans.sensor_lake import refresh_from_lake, start_lake_updates  # noqa: E402
from lakeline.schemas import READING, lake_schema  # noqa: E402
from lakeline.session import build_session  # noqa: E402
from lakeline.sinks import write_tsv  # noqa: E402
from lakeline.sources import read_kafka, read_lake_rejects, read_lines  # noqa: E402
from lakeline.streaming import start_dashboard, start_running_metrics  # noqa: E402


def _mail_logins(spark: SparkSession, args: argparse.Namespace) -> None:
    lines = read_lines(spark, args.input, args.encoding)
    needles = args.needle or mail_logins.LOGIN_NEEDLES
    counts = mail_logins.login_counts(lines, args.threshold, needles, args.collapse_spaces)
    write_tsv(counts, args.output)
    _report(args, mail_logins.login_events(lines, needles, args.collapse_spaces)[1])


def _salaries(spark: SparkSession, args: argparse.Namespace) -> None:
    lines = read_lines(spark, args.input, args.encoding)
    write_tsv(salaries.top_salaries(lines, args.top), args.output)
    _report(args, salaries.parse_salaries(lines)[1])


def _payroll(spark: SparkSession, args: argparse.Namespace) -> None:
    lines = payroll_lines(spark, args.input, args.header, args.encoding)
    write_tsv(title_counts(lines, args.trim), args.output)
    _report(args, title_of(lines, args.trim)[1])


def _report(args: argparse.Namespace, rejected: DataFrame) -> None:
    """Write the lines a job could not use as text, if it was asked to."""
    if args.rejects:
        rejected.select("value").write.text(args.rejects)


def _enrolments(spark: SparkSession, args: argparse.Namespace) -> None:
    config = JobConfig.load(args.config)
    store = DocTarget.load(args.documents) if args.documents else None
    target = (lambda name: store.named(name or config.collection)) if store else None
    questions = None
    if (args.since is None) != (args.until is None):
        raise SystemExit("--since and --until go together")
    if not args.admission and (args.sex or args.course or args.since):
        raise SystemExit("--sex, --course, --since and --until narrow the questions about --admission")
    if args.admission:
        questions = {"admission": args.admission, "sex": args.sex, "course": args.course}
        if args.since and args.until:
            questions["period"] = Period(args.since, args.until)
    load_students(spark, config, target, args.mode, args.staging, questions=questions)


def _lake(spark: SparkSession, args: argparse.Namespace) -> None:
    keys = args.key or ["sensor_type"]
    schema = StructType.fromDDL(args.schema) if args.schema else lake_schema(keys)
    targets = _dashboard_targets(args)
    if args.checkpoint:
        update = start_lake_updates(
            spark, args.input, targets, args.checkpoint, keys, schema=schema, source=args.option
        )
        update.awaitTermination()
    else:
        refresh_from_lake(spark, args.input, targets, keys, schema=schema)
    if args.rejects:
        # Those of all files so far, so a later run replaces them.
        rejects = read_lake_rejects(spark, args.input, schema).select("value", *READING.names)
        rejects.write.mode("overwrite").json(args.rejects)


def _stream(spark: SparkSession, args: argparse.Namespace) -> None:
    messages = read_kafka(spark, args.servers, args.topic, args.starting, **args.option)
    keys = args.key or ["sensor_type"]
    extra = [f for f in lake_schema(keys) if f.name not in READING.names]
    if args.document_envelopes:
        readings = decode_document_envelopes(messages, extra=extra)
    else:
        readings = decode_envelopes(
            messages, args.measurement_type, args.precision, args.source_zone, extra
        )
    trigger = {"processingTime": args.trigger} if args.trigger else None
    if args.dashboard:
        rows = readings.where("has_row")
        query = start_dashboard(rows, _dashboard_targets(args), args.checkpoint, keys, trigger)
    else:
        stores = [t.named("sensor_metrics") for t in _metric_stores(args)]
        query = start_running_metrics(readings, stores, args.checkpoint, trigger)
    query.awaitTermination()


def _dashboard_targets(args: argparse.Namespace) -> dict[str, list[Target]]:
    return {name: [t.named(name) for t in _metric_stores(args)] for name in TABLES}


def _option(text: str) -> tuple[str, str]:
    name, found, value = text.partition("=")
    if not found:
        raise argparse.ArgumentTypeError(f"expected NAME=VALUE, not {text}")
    return name, value


class _Options(argparse.Action):
    """Collects NAME=VALUE arguments."""

    def __call__(self, parser, namespace, value, option=None):
        setattr(namespace, self.dest, {**getattr(namespace, self.dest), value[0]: value[1]})


def _migrate(spark: SparkSession, args: argparse.Namespace) -> None:
    stores = [t.named("migration_metrics") for t in _metric_stores(args)]
    migrate_readings(spark, Target.load(args.source), Target.load(args.target), stores)


def _metric_stores(args: argparse.Namespace) -> list[Target]:
    stores: list[Target] = []
    if args.documents:
        stores.append(DocTarget.load(args.documents))
    if args.table:
        stores.append(TableTarget.load(args.table))
    return stores


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakeline")
    top.add_argument("--time-zone", default="UTC", help="session time zone")
    jobs = top.add_subparsers(dest="job", required=True)

    def add(name, run, *positional, **kwargs):
        job = jobs.add_parser(name, **kwargs)
        for argument in positional:
            job.add_argument(argument)
        job.set_defaults(run=run)
        return job

    def add_stores(job):
        job.add_argument("--documents", help="file that describes the document store")
        job.add_argument("--table", help="file that describes the relational store")

    def add_text(job):
        job.add_argument("--encoding", default="UTF-8")
        job.add_argument("--rejects", help="folder for the lines that could not be used")

    def add_keys(job):
        job.add_argument("--key", action="append", help="column that tells sensors apart; repeatable")
        job.add_argument(
            "--option", type=_option, action=_Options, default={}, metavar="NAME=VALUE",
            help="option of the source, such as maxOffsetsPerTrigger or maxFilesPerTrigger",
        )

    job = add("mail-logins", _mail_logins, "input", "output", help="logins per mail user")
    job.add_argument("--threshold", type=int, default=mail_logins.THRESHOLD)
    job.add_argument("--needle", action="append", help="text a login line holds; repeatable")
    job.add_argument("--collapse-spaces", action="store_true")
    add_text(job)

    job = add("salaries", _salaries, "input", "output", help="highest salaries")
    job.add_argument("--top", type=int, default=salaries.TOP)
    add_text(job)

    job = add("payroll", _payroll, "input", "output", help="people per job title")
    job.add_argument("--header", action="store_true", help="the first line is a header")
    job.add_argument("--trim", action="store_true", help="strip titles")
    add_text(job)

    job = add("enrolments", _enrolments, "config", help="students and their summaries")
    job.add_argument("--documents", help="file that describes the document store")
    job.add_argument("--mode", default="errorifexists")
    job.add_argument("--staging", help="shared folder for the parsed file")
    job.add_argument("--admission", help="also answer the questions about this admission")
    job.add_argument("--sex", help="narrow the questions to a sex")
    job.add_argument("--course", help="course to count students of")
    date = datetime.date.fromisoformat
    job.add_argument("--since", type=date, help="first day of the period asked about")
    job.add_argument("--until", type=date, help="day after the period")

    job = add("lake", _lake, "input", help="refresh sensor metrics from the lake directory")
    add_keys(job)
    job.add_argument("--schema", help="columns of the files as DDL; by default keys, then the reading")
    job.add_argument("--checkpoint", help="update from files not read before, remembered here")
    job.add_argument("--rejects", help="folder for the lines that are no reading")
    add_stores(job)

    job = add("stream", _stream, help="sensor metrics or the whole dashboard from a topic")
    for option in ("--servers", "--topic", "--checkpoint"):
        job.add_argument(option, required=True)
    job.add_argument("--starting", default="earliest")
    job.add_argument("--document-envelopes", action="store_true")
    job.add_argument("--dashboard", action="store_true", help="keep every dashboard table")
    job.add_argument("--trigger", help="time between micro-batches, such as '1 minute'")
    job.add_argument("--measurement-type", default="float", choices=("float", "double"))
    job.add_argument("--precision", default="second", choices=("second", "micro"))
    job.add_argument("--source-zone", default="UTC")
    add_keys(job)
    add_stores(job)

    job = add("migrate", _migrate, "source", "target", help="copy readings between stores")
    add_stores(job)
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(build_session(f"lakeline-{args.job}", time_zone=args.time_zone), args)


if __name__ == "__main__":
    main()
