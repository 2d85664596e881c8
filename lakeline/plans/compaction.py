"""Small lake files gathered into Parquet files of bounded size, beside the lake."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeline.schemas import DAMAGED, READING, with_damaged
from lakeline.sinks.files import children
from lakeline.sources.files import lake_lines
from lakeline.streaming.runs import Run, RunStore

_MANIFEST = "manifest-"


class CompactedLake:
    """The readings of a lake directory, most of them from few files.

    ``compact`` gathers the lake files that no run holds yet: a task reads many small
    ones, up to ``target_bytes`` of text, and writes them as one Parquet file; what
    Spark would split stays split. The files of the lake are not touched, so jobs that
    read them go on. A run names its files in a manifest, written first, which counts from
    the moment the run is complete: a reader sees all files of a run through it, or none.
    ``fold`` runs of a tier become one of the next, so neither runs nor small files pile
    up. Runs that a merge replaces go with the merge after it, so that readers have time.

    Lake files are written once. One that changed after it was gathered stops the job.
    The driver sees the names of new files, as the file source itself does. A run leaves
    one small manifest.
    """

    def __init__(
        self,
        spark: SparkSession,
        lake: str,
        path: str,
        schema: StructType = READING,
        target_bytes: int = 256 << 20,
        fold: int = 8,
    ) -> None:
        self._spark = spark
        self._lake = lake
        self._path = path.rstrip("/")
        self._schema = schema
        self._target_bytes = target_bytes
        self._runs = RunStore(spark, self._path, lambda rows, _: rows, fold, linger=True)

    def compact(self) -> int:
        """Gather the files no run holds; how many they were. A run that broke is done again."""
        held = self._runs.runs()
        fresh = self._fresh(held)
        new = fresh.collect()
        if new:
            number = _newest(held) + 1
            named = self._spark.createDataFrame(new, fresh.schema).coalesce(1)
            named.write.mode("overwrite").parquet(f"{self._path}/{_MANIFEST}{number}")
            with self._in_large_tasks():
                self._runs.add(self._lines([row.path for row in new]), number)
        return len(new)

    def read(self) -> DataFrame:
        """All readings of the lake: those of runs, and of files that came since."""
        return self._all().where(F.col(DAMAGED).isNull()).drop(DAMAGED)

    def rejects(self) -> DataFrame:
        """Lines that are no reading, as ``read_lake_rejects`` gives them."""
        return self._all().where(F.col(DAMAGED).isNotNull()).withColumnRenamed(DAMAGED, "value")

    def files(self) -> DataFrame:
        """``path``, ``length`` and ``modified`` of every lake file; their content is not read."""
        listed = self._spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,json}")
        return listed.load(self._lake).select(
            "path", "length", F.col("modificationTime").alias("modified")
        )

    def manifest(self) -> DataFrame | None:
        """The files that complete runs hold; None before the first run."""
        return self._held_by(self._runs.runs())

    def _held_by(self, runs: list[Run]) -> DataFrame | None:
        names = [n for n in children(self._spark, self._path) if n.startswith(_MANIFEST)]
        live = [n for n in names if int(n.removeprefix(_MANIFEST)) <= _newest(runs)]
        return self._spark.read.parquet(*(f"{self._path}/{n}" for n in live)) if live else None

    def _fresh(self, runs: list[Run]) -> DataFrame:
        held = self._held_by(runs)
        if held is None:
            return self.files()
        then = held.select("path", *(F.col(c).alias(f"then_{c}") for c in ("length", "modified")))
        both = self.files().join(then, "path", "left")
        changed = both.where("then_length <> length OR then_modified <> modified").limit(1).collect()
        if changed:
            raise ValueError(f"{changed[0].path} changed after it was gathered")
        return both.where("then_length IS NULL").select("path", "length", "modified")

    def _all(self) -> DataFrame:
        # One list of runs decides what is gathered and what is fresh, whatever ends meanwhile.
        runs = self._runs.runs()
        fresh = [row.path for row in self._fresh(runs).select("path").collect()]
        if not runs:
            return self._lines(fresh)
        reader = self._spark.read.schema(with_damaged(self._schema))
        gathered = reader.parquet(*(f"{self._path}/{run.name}" for run in runs))
        return gathered.unionByName(self._lines(fresh)) if fresh else gathered

    def _lines(self, paths: list[str]) -> DataFrame:
        parts = [
            lake_lines(self._spark.read, found, self._schema, kind)
            for kind in ("csv", "json")
            if (found := [_literal(p) for p in paths if p.endswith(f".{kind}")])
        ]
        if not parts:
            return self._spark.createDataFrame([], with_damaged(self._schema))
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]

    @contextmanager
    def _in_large_tasks(self) -> Iterator[None]:
        """A task takes files of ``target_bytes`` in all, each counted as a thousandth of it or more."""
        with _settings(
            self._spark,
            {
                "spark.sql.files.maxPartitionBytes": str(self._target_bytes),
                "spark.sql.files.openCostInBytes": str(max(1, self._target_bytes // 1024)),
                "spark.sql.files.minPartitionNum": "1",
            },
        ):
            yield


def _newest(runs: list[Run]) -> int:
    return max((run.last for run in runs), default=-1)


@contextmanager
def _settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, old in before.items():
            spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def _literal(path: str) -> str:
    """A path in which no sign stands for other ones."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)
