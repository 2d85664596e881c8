"""Tables in files kept day by day, of which a change writes only its days."""

from __future__ import annotations

import datetime
from collections.abc import Collection, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.config import DocTarget, Target
from lakeline.sinks.files import children, create_marker, matching, remove
from lakeline.sinks.stores import save, write_batch
from lakeline.sources.stores import read_target

DAY, VERSION = "day", "version"
#: The day of rows without a time.
TIMELESS = "none"
_MARK = "_committed-"


def day_of(time: str) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit(TIMELESS))


class DayStore:
    """Rows in a folder per day and version; the newest committed version of each day counts.

    A version writes new folders for the days it changes and overwrites only its own,
    so a repeat changes nothing and readers are not disturbed. It counts, with all its
    days at once, when it is committed. Of each day the version before is kept for those
    who read it, and for a repeat of the newest; older ones go.
    """

    def __init__(self, spark: SparkSession, target: Target) -> None:
        self._spark = spark
        self._target = target
        self._path = target.path.rstrip("/")

    def days(self, before: int | None = None) -> dict[str, int]:
        """The version that counts for each day; with ``before`` only older ones are looked at."""
        newest = self._committed() if before is None else before - 1
        live: dict[str, int] = {}
        for day, version in self._folders():
            if version <= newest:
                live[day] = max(version, live.get(day, version))
        return live

    def read(self, days: Collection[str] | None = None, before: int | None = None) -> DataFrame | None:
        """The rows of these days, or of all; None if there are none."""
        live = self.days(before)
        wanted = sorted(d for d in live if days is None or d in days)
        return self.read_folders({d: live[d] for d in wanted})

    def read_folders(self, versions: Mapping[str, int]) -> DataFrame | None:
        if not versions:
            return None
        reader = self._spark.read.format(self._target.format).options(**self._options())
        if self._target.schema is not None:
            reader = reader.schema(self._target.schema)
        return reader.load([self._folder(d, v) for d, v in sorted(versions.items())])

    def write(self, rows: DataFrame, version: int) -> None:
        """Write the rows, with their ``day``, as this version of their days.

        Each day goes through as many tasks as its rows are worth: adaptive execution
        splits what is large and merges what is small.
        """
        numbered = rows.withColumn(VERSION, F.lit(version)).hint("rebalance", DAY)
        (
            numbered.write.format(self._target.format)
            .options(**self._options(), partitionOverwriteMode="dynamic")
            .mode("overwrite")
            .partitionBy(DAY, VERSION)
            .save(self._path)
        )

    def commit(self, version: int) -> None:
        """Let this version count, and remove what neither it nor the one before needs."""
        create_marker(self._spark, f"{self._path}/{_MARK}{version}")
        folders: dict[str, list[int]] = {}
        for day, number in self._folders():
            if number <= version:
                folders.setdefault(day, []).append(number)
        # Only days of this version have something to remove.
        for day, numbers in folders.items():
            if version in numbers:
                for number in sorted(numbers)[:-2]:
                    remove(self._spark, self._folder(day, number))
        for mark in self._marks():
            if mark < version:
                remove(self._spark, f"{self._path}/{_MARK}{mark}")

    def _committed(self) -> int:
        return max(self._marks(), default=-1)

    def _marks(self) -> list[int]:
        names = children(self._spark, self._path)
        return [int(n.removeprefix(_MARK)) for n in names if n.startswith(_MARK)]

    def _folders(self) -> list[tuple[str, int]]:
        found = matching(self._spark, f"{self._path}/{DAY}=*/{VERSION}=*")
        parts = [path.rsplit("/", 2)[1:] for path in found]
        return [(d.removeprefix(f"{DAY}="), int(v.removeprefix(f"{VERSION}="))) for d, v in parts]

    def _folder(self, day: str, version: int) -> str:
        return f"{self._path}/{DAY}={day}/{VERSION}={version}"

    def _options(self) -> dict[str, str]:
        return {k: v for k, v in self._target.options.items() if k != "path"}


def write_days(
    rows: DataFrame, targets: Sequence[Target], version: int, keys: Sequence[str]
) -> None:
    """Save the rows of changed days, with their ``day``, to every target.

    Files replace those days. A document store replaces the documents of the same
    ``keys``. A table gets the rows as a batch of its own, see ``write_batch``, and
    ``latest_state`` reads the newest row of each key.
    """
    for target in targets:
        if target.path is not None:
            store = DayStore(rows.sparkSession, target)
            store.write(rows, version)
            store.commit(version)
        elif isinstance(target, DocTarget):
            options = {"operationType": "replace", "idFieldList": ",".join(keys)}
            save(rows.drop(DAY), replace(target, options={**target.options, **options}))
        else:
            write_batch(rows.drop(DAY), target, version, keys)


def read_days(
    spark: SparkSession,
    target: Target,
    since: datetime.date | None = None,
    until: datetime.date | None = None,
) -> DataFrame:
    """A table that ``write_days`` saved, or its days from ``since`` to before ``until``.

    A target in files is asked for those days only. Other stores hold one table.
    """
    if target.path is None:
        return read_target(spark, target)
    store = DayStore(spark, target)
    live = store.days()
    low, high = str(since or ""), str(until or "~")
    bounded = since is not None or until is not None
    wanted = {d: v for d, v in live.items() if not bounded or (d != TIMELESS and low <= d < high)}
    found = store.read_folders(wanted)
    if found is None:
        if target.schema is None:
            raise ValueError(f"{target.path} holds no rows, and the target names no schema")
        return spark.createDataFrame([], target.schema)
    return found
