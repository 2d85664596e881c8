"""A dashboard kept up to date by a stream of readings, by its changes alone."""

from __future__ import annotations

import datetime
from collections.abc import Collection, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeline.config import TableTarget, Target
from lakeline.operators.dashboard import dashboard_tables
from lakeline.operators.rollup import merge_rollups, rollup, total_means
from lakeline.operators.sensors import HOUR
from lakeline.operators.smoothing import smooth
from lakeline.sinks.days import DAY, TIMELESS, DayStore, day_of, write_days
from lakeline.sinks.stores import write_version
from lakeline.streaming.jobs import Trigger, start_writer
from lakeline.streaming.runs import RunStore

#: Tables with a row per bucket, kept day by day; the others have a row per sensor at most.
BY_DAY = ("sensor_buckets", "sensor_smoothing")
#: Buckets that a smoothed value reaches back to.
REACH = 4

_FIRST, _LAST = "first_valid", "last_valid"


class DashboardStore:
    """What a dashboard is derived from, under one folder.

    ``buckets`` holds the rollup by day, of which a batch rewrites the days it touches.
    ``sensors`` holds the rollup of each sensor over all time in tiers of runs, to
    which a batch adds the sensors it touches. Both take a repeated batch as one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], fold: int = 8) -> None:
        self._spark = spark
        self._keys = list(keys)
        base = path.rstrip("/")
        self._buckets = DayStore(spark, TableTarget.parquet_files(f"{base}/buckets"))
        self._sensors = RunStore(spark, f"{base}/sensors", self._merge_sensors, fold)
        self._arrived = f"{base}/arrived"

    def add(self, batch: DataFrame, batch_id: int, width: str) -> list[str]:
        """Add the readings of a batch; the days they touch."""
        # Written once and read several times; a repeat overwrites it.
        rollup(batch, self._keys, width).withColumn(DAY, day_of("bucket")).write.mode(
            "overwrite"
        ).parquet(self._arrived)
        arrived = self._spark.read.parquet(self._arrived)
        days = [row[0] for row in arrived.select(DAY).distinct().collect()]
        held = self._buckets.read(days, before=batch_id)
        both = arrived.drop(DAY) if held is None else held.unionByName(arrived.drop(DAY))
        merged = merge_rollups(both, self._keys).withColumn(DAY, day_of("bucket"))
        if days:
            self._buckets.write(merged, batch_id)
        self._buckets.commit(batch_id)
        self._sensors.add(self._of_sensors(arrived), batch_id)
        return days

    def sensors(self) -> DataFrame | None:
        """The rollup of each sensor over all time, in its only bucket."""
        return self._sensors.rows()

    def buckets(self, days: Collection[str] | None = None) -> DataFrame | None:
        """The rollup of these days, or of all."""
        return self._buckets.read(days)

    def smoothed(self, days: Collection[str]) -> DataFrame | None:
        """Smoothed buckets, with their ``day``, of all days that a change of these days reaches.

        A bucket counts in the smoothed value of the next ``REACH`` buckets with data
        of its sensor. So further days are looked at, in strides that double, until each
        sensor has so many after the change, and so many before the first day that is
        smoothed again; its first and last bucket, known from ``sensors``, end the search.
        """
        timed = sorted(d for d in self._buckets.days() if d != TIMELESS)
        changed = sorted(set(days) & set(timed))
        if not changed:
            return None
        again = sorted({*changed, *self._reached(timed, changed, forward=True)})
        around = sorted({*again, *self._reached(timed, again, forward=False)})
        means = total_means(self._buckets.read(around), self._keys)
        return smooth(means, self._keys).withColumn(DAY, day_of("bucket")).where(F.col(DAY).isin(again))

    def _reached(self, timed: list[str], origins: list[str], forward: bool) -> set[str]:
        """Days after (or before) the origins that hold some of the next ``REACH`` buckets of a sensor."""
        numbers = {d: datetime.date.fromisoformat(d).toordinal() for d in timed}
        at = [numbers[d] for d in origins]
        sign = 1 if forward else -1
        furthest = max(numbers.values()) if forward else min(numbers.values())
        stride = 1
        while True:
            near = {d for d in timed if any(0 < sign * (numbers[d] - o) <= stride for o in at)}
            if not near:
                if all(sign * (furthest - o) <= stride for o in at):
                    return set()
                stride *= 2
                continue
            counts = self._days_with_data({*near, *origins}).withColumns(
                {
                    "place": sign * F.datediff(F.col(DAY).cast("date"), F.lit("1970-01-01")).cast("long"),
                    "origin": F.col(DAY).isin(origins),
                }
            )
            walk = Window.partitionBy(*self._keys).orderBy("place")
            before = walk.rowsBetween(Window.unboundedPreceding, -1)
            # Buckets since the nearest origin in front, which has the fewest in between.
            counts = counts.withColumn("met", F.sum("n").over(walk))
            counts = counts.withColumns(
                {
                    "at_origin": F.last(F.when(F.col("origin"), F.col("met")), True).over(before),
                    "found": F.sum("n").over(walk.rangeBetween(1, stride)),
                }
            )
            needed = F.col("met") - F.col("n") - F.col("at_origin") < REACH
            # A sensor without data beyond the stride has nothing further to be found.
            short = F.col("origin") & (F.coalesce("found", F.lit(0)) < REACH)
            limits = self._sensors.rows().select(
                *[F.col(k).alias(f"_{k}") for k in self._keys], F.col(_LAST if forward else _FIRST).alias("_end")
            )
            same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self._keys))
            end = sign * F.datediff(F.col("_end").cast("date"), F.lit("1970-01-01"))
            found = counts.join(limits, same, "left").agg(
                F.collect_set(F.when(needed, F.col(DAY))), F.max(short & (end > F.col("place") + stride))
            )
            days, unfinished = found.first()
            if not unfinished:
                return set(days)
            stride *= 2

    def _days_with_data(self, days: Collection[str]) -> DataFrame:
        """How many buckets with valid readings each sensor has on each of these days."""
        valid = self._buckets.read(days).where("n > n_invalid")
        return valid.groupBy(*self._keys, day_of("bucket").alias(DAY)).agg(F.count("*").alias("n"))

    def _of_sensors(self, arrived: DataFrame) -> DataFrame:
        """The rollup of a batch without its buckets; they leave their first and last one with data."""
        valid = F.when(F.col("n") > F.col("n_invalid"), F.col("bucket"))
        marked = arrived.drop(DAY).withColumns({_FIRST: valid, _LAST: valid})
        return self._merge_sensors(marked, False)

    def _merge_sensors(self, totals: DataFrame, oldest: bool) -> DataFrame:
        timeless = totals.withColumn("bucket", F.lit(None).cast("timestamp"))
        ends = (F.min(_FIRST).alias(_FIRST), F.max(_LAST).alias(_LAST))
        return merge_rollups(timeless, self._keys, *ends)


def start_dashboard(
    readings: DataFrame,
    targets: Mapping[str, Sequence[Target]],
    checkpoint: str,
    keys: Sequence[str] = ("sensor_type",),
    trigger: Trigger | None = None,
    horizon: datetime.timedelta = HOUR,
    width: str = "1 hour",
    fold: int = 8,
) -> StreamingQuery:
    """Save the named dashboard tables to their targets after every micro-batch.

    Under the checkpoint lies the rollup of all readings by day, and that of each sensor.
    A batch rewrites the days it touches, of the rollup and of ``sensor_buckets``, and
    the days of ``sensor_smoothing`` that its buckets and the four after them lie on; so
    what it writes depends on its days and the number of sensors, not on the length of
    the history. The other tables have a row per sensor at most, and are new versions.
    All equal those of a batch job over all readings so far, late ones included.
    """

    def save_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = DashboardStore(spark, f"{checkpoint}/rollups", keys, fold)
        days = store.add(batch, batch_id, width)
        by_sensor = dashboard_tables(store.sensors(), keys, horizon=horizon)
        for name, stores in targets.items():
            if name not in BY_DAY:
                write_version(by_sensor[name], stores, batch_id)
                continue
            if name == "sensor_buckets":
                held = store.buckets([d for d in days if d != TIMELESS])
                rows = held and total_means(held, keys).withColumn(DAY, day_of("bucket"))
            else:
                rows = store.smoothed(days)
            if rows is not None:
                write_days(rows, stores, batch_id, [*keys, "bucket"])

    writer = readings.writeStream.foreachBatch(save_batch)
    return start_writer(writer, f"{checkpoint}/query", trigger)
