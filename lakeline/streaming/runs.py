"""Rows of micro-batches kept in a shared folder and merged in tiers."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from lakeline.sinks.files import children, is_committed, remove

#: Merges rows of several runs; the flag says whether the oldest run is among them.
Merge = Callable[[DataFrame, bool], DataFrame]


class Run(NamedTuple):
    """A folder with the merged rows of the batches ``first`` to ``last``."""

    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"run-{self.level}-{self.first}-{self.last}"

    def covers(self, other: Run) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


class RunStore:
    """Runs of micro-batches: ``fold`` of a level become one of the next.

    So a row is written again once a level, and at most ``fold`` runs of each level
    are read, however long the stream goes on. A batch overwrites its own run, so a
    repeat adds nothing. A merged run counts once it is complete, and what it covers is
    passed over from then on; it is removed afterwards, now or by a later merge. With
    ``linger`` always by a later one, for the sake of those who read it.
    """

    def __init__(
        self, spark: SparkSession, path: str, merge: Merge, fold: int = 8, linger: bool = False
    ) -> None:
        self._spark = spark
        self._path = path.rstrip("/")
        self._merge = merge
        self._fold = fold
        self._linger = linger

    def add(self, rows: DataFrame, batch_id: int) -> None:
        run = Run(0, batch_id, batch_id)
        if any(other.covers(run) for other in self.runs()):
            return  # a repeat of a batch that is merged already
        self._write(rows, run)
        self._fold_up()

    def rows(self) -> DataFrame | None:
        """The merged rows of all batches so far; None before the first one."""
        live = self.runs()
        return self._merged(live, True) if live else None

    def runs(self) -> list[Run]:
        """Complete runs that no other one covers, in order of their batches."""
        complete = self._complete()
        live = [r for r in complete if not any(other.covers(r) for other in complete)]
        return sorted(live, key=lambda r: r.first)

    def _complete(self) -> list[Run]:
        names = [n for n in children(self._spark, self._path) if n.startswith("run-")]
        runs = [Run(*map(int, n.split("-")[1:])) for n in names]
        return [r for r in runs if is_committed(self._spark, self._at(r))]

    def _covered(self) -> list[Run]:
        complete = self._complete()
        return [r for r in complete if any(other.covers(r) for other in complete)]

    def _fold_up(self) -> None:
        live = self.runs()
        level = 0
        while len(full := [r for r in live if r.level == level]) >= self._fold:
            merged = Run(level + 1, full[0].first, full[-1].last)
            replaced = self._covered() if self._linger else []
            self._write(self._merged(full, full[0] == live[0]), merged)
            for run in replaced if self._linger else self._covered():
                remove(self._spark, self._at(run))
            live = self.runs()
            level += 1

    def _merged(self, runs: list[Run], oldest: bool) -> DataFrame:
        return self._merge(self._spark.read.parquet(*map(self._at, runs)), oldest)

    def _write(self, rows: DataFrame, run: Run) -> None:
        rows.write.mode("overwrite").parquet(self._at(run))

    def _at(self, run: Run) -> str:
        return f"{self._path}/{run.name}"
