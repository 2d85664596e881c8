"""Tables, collections, migrations between them and metrics saved to several stores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.config import DocTarget, TableTarget, Target
from lakeline.sinks.files import children, is_committed, remove
from lakeline.sources.stores import read_target, read_whole

BATCH = "batch_id"
VERSION = "version"
#: What a save does to a store that holds something already.
IF_EMPTY = "errorifexists"


def save(df: DataFrame, target: Target, mode: str = "append") -> None:
    df.write.format(target.format).options(**target.options).mode(mode).save()


def write_docs(df: DataFrame, target: DocTarget, mode: str = IF_EMPTY) -> None:
    """Save to a document collection; by default only if it holds nothing yet."""
    held = mode == IF_EMPTY and target.path is None and not _holds_nothing(df, target)
    save(df, target, accepted_mode(target, mode, held))


def accepted_mode(target: Target, mode: str, holds_something: bool) -> str:
    """The mode by which a store is written to.

    Connectors take only ``append`` and ``overwrite``, so they are appended to if they
    hold nothing; files know the mode themselves.
    """
    if mode != IF_EMPTY or target.path is not None:
        return mode
    if holds_something:
        raise ValueError(f"the {target.format} store holds documents already")
    return "append"


def _holds_nothing(df: DataFrame, target: Target) -> bool:
    stored = replace(target, schema=target.schema or df.schema)
    return read_target(df.sparkSession, stored).limit(1).isEmpty()


def write_table(
    df: DataFrame, url: str, table: str, mode: str = "append", **options: str
) -> None:
    """Append to a relational table, creating it if missing.

    Each task commits on its own. Give the table a primary key, so that a task
    repeated after a lost executor fails on the duplicate instead of adding it.
    """
    save(df, TableTarget.jdbc(url, table, **options), mode)


def migrate(spark: SparkSession, source: Target, target: Target, mode: str = "append") -> None:
    """Copy a whole store into another, straight from the readers' tasks to the writers'.

    A table needs a partition column, see ``read_whole``.
    """
    save(read_whole(spark, source), target, mode)


def write_batch(df: DataFrame, target: Target, batch_id: int, keys: Sequence[str] = ()) -> None:
    """Add one batch to a store, tagged with its id; writing it again adds nothing.

    Files take a directory per batch, which a repeat overwrites. A document store
    upserts on ``batch_id`` and ``keys``. A table is asked for the batch's rows
    first, and only the missing ones are appended.
    """
    tagged = df.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
    if target.path is not None:
        directory = f"{target.path.rstrip('/')}/{BATCH}={batch_id}"
        save(df, Target(target.format, {**target.options, "path": directory}), "overwrite")
    elif isinstance(target, DocTarget):
        save(tagged, upserting(target, keys))
    else:
        save(tagged.limit(0), target)  # creates the table for the first batch
        stored = read_target(df.sparkSession, target).where(F.col(BATCH) == batch_id)
        save(missing_rows(tagged, stored, (BATCH, *keys)), target)


def missing_rows(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not stored yet; NULL keys match each other."""
    same = (F.col(f"new.{k}").eqNullSafe(F.col(f"seen.{k}")) for k in keys)
    condition = reduce(lambda a, b: a & b, same)
    return rows.alias("new").join(stored.alias("seen"), condition, "left_anti")


def upserting(target: DocTarget, keys: Sequence[str]) -> DocTarget:
    """The target with connector options that replace a document of the same keys."""
    options = {"operationType": "replace", "idFieldList": ",".join((BATCH, *keys))}
    return DocTarget(target.format, {**target.options, **options}, target.schema)


def write_metrics(
    df: DataFrame,
    targets: Sequence[Target],
    batch_id: int | None = None,
    keys: Sequence[str] = (),
) -> None:
    """Save metrics to every target, computing them once.

    Without ``batch_id`` each target is left holding just these metrics; with it
    they are added to the history, where a repeated batch changes nothing.
    """
    metrics = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for target in targets:
            if batch_id is None:
                save(metrics, _truncating(target), "overwrite")
            else:
                write_batch(metrics, target, batch_id, keys)
    finally:
        metrics.unpersist()


def write_version(df: DataFrame, targets: Sequence[Target], version: int) -> None:
    """Save metrics to every target as its newest version, computing them once.

    Files take a directory per version, and older ones go when it is complete; so a
    reader of ``read_version`` always finds a whole table, and a repeat changes
    nothing. Other stores are replaced.
    """
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for target in targets:
            if target.path is None:
                save(rows, _truncating(target), "overwrite")
                continue
            base = target.path.rstrip("/")
            options = {**target.options, "path": f"{base}/{VERSION}={version}"}
            save(rows, Target(target.format, options), "overwrite")
            for name in children(df.sparkSession, base):
                if name.startswith(f"{VERSION}=") and int(name.partition("=")[2]) < version:
                    remove(df.sparkSession, f"{base}/{name}")
    finally:
        rows.unpersist()


def read_version(spark: SparkSession, target: Target) -> DataFrame:
    """The newest complete version of a table that ``write_version`` saved."""
    if target.path is None:
        return read_target(spark, target)
    base = target.path.rstrip("/")
    found = [n for n in children(spark, base) if n.startswith(f"{VERSION}=")]
    whole = [n for n in found if is_committed(spark, f"{base}/{n}")]
    newest = max(whole, key=lambda n: int(n.partition("=")[2]))
    options = {**target.options, "path": f"{base}/{newest}"}
    return read_target(spark, replace(target, options=options))


def _truncating(target: Target) -> Target:
    """Keep a table's definition and grants when its rows are replaced."""
    if target.format != "jdbc":
        return target
    return TableTarget(target.format, {**target.options, "truncate": "true"})
