"""Proof that a copy is complete, and copies that go on where they stopped."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeline.config import DocTarget, Target
from lakeline.sinks.files import children, create_marker, is_committed, remove
from lakeline.sinks.stores import missing_rows, save
from lakeline.sources.stores import read_target, read_whole

#: Ranges that a range is cut into, and rows of a range that are compared one by one.
FANOUT, LEAF = 256, 100_000


@dataclass(frozen=True)
class Range:
    """Keys from ``low`` to before ``high``; both None: rows without a key."""

    low: int | None
    high: int | None

    def holds(self, key: Column) -> Column:
        if self.low is None:
            return key.isNull()
        return (key >= self.low) & (key < self.high)


def differences(
    source: DataFrame,
    target: DataFrame,
    key: str,
    columns: Sequence[str] | None = None,
    fanout: int = FANOUT,
    leaf: int = LEAF,
) -> DataFrame:
    """``key, status, n_source, n_target`` of every key whose rows are not the same on both sides.

    ``status`` is ``lost`` or ``extra`` if one side has no such row, ``missing`` or
    ``doubled`` if the target has it less or more often, else ``changed``.

    Both sides are told by the count and two order-free digests of their rows in
    ``fanout`` ranges of the key; only ranges that differ are cut again, until they have
    few rows or one key, and only their rows are compared by key. So a complete copy
    costs one scan of each side and no shuffle of rows; a round after that reads the
    ranges that differ, as plain comparisons that reach the scan. The driver sees one
    row for each range. Keys are whole numbers, or else the ranges are those of their
    64-bit hash, and every round reads both sides again.
    """
    columns = list(columns or source.columns)
    place = _place(source, target, key)
    sides = [_told(df, key, place, columns) for df in (source, target)]
    bounds = [side.agg(F.min("place"), F.max("place")).first() for side in sides]
    low = min((b[0] for b in bounds if b[0] is not None), default=0)
    high = 1 + max((b[1] for b in bounds if b[1] is not None), default=-1)
    widths = [max(1, -(-(high - low) // fanout))]
    open_ranges = [Range(None, None), *_cut(Range(low, high), widths[0])]
    leaves: list[Range] = []
    while open_ranges:
        differing = _differing(sides, open_ranges, low, widths)
        widths.append(max(1, -(-widths[-1] // fanout)))
        open_ranges = []
        for found, rows in differing:
            if found.low is None or rows <= leaf or found.high - found.low <= 1:
                leaves.append(found)
            else:
                open_ranges += _cut(found, widths[-1])
        if len(open_ranges) > 16 * fanout:
            # So much differs that one join of it all is cheaper than further rounds.
            leaves += open_ranges
            break
    return _by_key(sides, _joined(leaves), source.schema[key])


def _place(source: DataFrame, target: DataFrame, key: str) -> Column:
    """Where a key lies among the ranges: the key itself, if it is a whole number of at most 61 bits."""
    own = F.col(f"`{key}`")
    kinds = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if all(isinstance(df.schema[key].dataType, kinds) for df in (source, target)):
        ends = [df.agg(F.min(own), F.max(own)).first() for df in (source, target)]
        if all(end is None or abs(end) < 1 << 61 for pair in ends for end in pair):
            return own.cast("long")
    return F.when(own.isNotNull(), F.shiftrightunsigned(F.xxhash64(own.cast("string")), 3))


def _told(df: DataFrame, key: str, place: Column, columns: Sequence[str]) -> DataFrame:
    """``key``, its ``place`` among the ranges, and two hashes of the row."""
    texts = [_text(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]
    return df.select(
        F.col(f"`{key}`").alias("key"),
        place.alias("place"),
        F.xxhash64(*texts).alias("one"),
        F.xxhash64(F.lit(1), *texts).alias("two"),
    )


def _text(value: Column, kind: T.DataType) -> Column:
    """The same text for the same value, whichever store it comes from; NULL stays apart from it."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value.cast("double")
        value = F.when(value == 0, F.lit(0.0)).otherwise(value)  # no negative zero
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat(F.lit("="), value.cast("string"))


def _cut(found: Range, width: int) -> list[Range]:
    return [Range(a, min(a + width, found.high)) for a in range(found.low, found.high, width)]


def _joined(ranges: Sequence[Range]) -> list[Range]:
    """The ranges with neighbours made one, so that a condition on them stays short."""
    merged = [r for r in ranges if r.low is None]
    for found in sorted((r for r in ranges if r.low is not None), key=lambda r: r.low):
        if merged and merged[-1].high == found.low and merged[-1].low is not None:
            merged[-1] = Range(merged[-1].low, found.high)
        else:
            merged.append(found)
    return merged


def _within(ranges: Sequence[Range]) -> Column:
    conditions = [r.holds(F.col("place")) for r in _joined(ranges)]
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _differing(
    sides: Sequence[DataFrame], ranges: Sequence[Range], low: int, widths: Sequence[int]
) -> list[tuple[Range, int]]:
    """Ranges whose digests differ, with the larger number of rows."""
    known = {r.low: r for r in ranges}
    # The start of the range that holds a place, from the widths of the rounds so far.
    spot = F.lit(low).cast("long")
    for width in widths:
        spot = spot + F.floor((F.col("place") - spot) / width) * width
    found: dict[int | None, list[tuple]] = {}
    for number, side in enumerate(sides):
        digests = (
            side.where(_within(ranges))
            .groupBy(spot.alias("low"))
            .agg(
                F.count("*").alias("n"),
                F.bit_xor("one").alias("xor"),
                F.sum(F.col("two").cast("decimal(20,0)")).alias("sum"),
            )
        )
        for row in digests.collect():
            found.setdefault(row.low, [(0, None, None)] * 2)[number] = (row.n, row.xor, row.sum)
    return [(known[low], max(a[0], b[0])) for low, (a, b) in found.items() if a != b]


def _by_key(sides: Sequence[DataFrame], ranges: Sequence[Range], field: T.StructField) -> DataFrame:
    tagged = [
        side.where(_within(ranges)).select("key", "one", "two", F.lit(number).alias("side"))
        for number, side in enumerate(sides)
    ]
    counts = {name: F.count_if(F.col("side") == n).alias(name) for n, name in enumerate(("n_source", "n_target"))}

    def digest(side: int) -> Column:
        own = F.col("side") == side
        return F.struct(
            F.bit_xor(F.when(own, F.col("one"))),
            F.sum(F.when(own, F.col("two").cast("decimal(20,0)"))),
        )

    grouped = tagged[0].unionByName(tagged[1]).groupBy("key").agg(
        *counts.values(), digest(0).alias("source"), digest(1).alias("target")
    )
    status = (
        F.when(F.col("n_target") == 0, "lost")
        .when(F.col("n_source") == 0, "extra")
        .when(F.col("n_target") < F.col("n_source"), "missing")
        .when(F.col("n_target") > F.col("n_source"), "doubled")
        .when(~F.col("source").eqNullSafe(F.col("target")), "changed")
    )
    result = grouped.select(F.col("key").alias(field.name), status.alias("status"), "n_source", "n_target")
    return result.where(F.col("status").isNotNull())


def copy_in_parts(
    spark: SparkSession,
    source: Target,
    target: Target,
    key: str,
    manifest: str,
    parts: int = 64,
    at_most: int | None = None,
) -> int:
    """Copy a store range by range of a key; a restart copies the ranges that are not done. How many.

    ``manifest`` is a folder all executors share. It holds the ranges, fixed by the first
    run, and a mark for each one that is done; rows beyond the first run's keys are in
    the outermost ranges. A broken range is copied again without doubles: in files it has a
    directory of its own that is overwritten, a document store replaces documents of the
    same key, and a table gets only the rows whose key it lacks. There ``key`` must be
    unique; files take any whole number. ``at_most`` ends a run after so many ranges.
    """
    rows = read_whole(spark, source)
    ranges = _planned(spark, rows, key, manifest, parts)
    done = {int(n.removeprefix("done-")) for n in children(spark, manifest) if n.startswith("done-")}
    copied = 0
    for number, found in enumerate(ranges):
        if number in done or copied == at_most:
            continue
        own = rows.where(_holding(found, number, len(ranges), F.col(f"`{key}`")))
        _save_part(own, target, key, number)
        create_marker(spark, f"{manifest}/done-{number}")
        copied += 1
    return copied


def _planned(spark: SparkSession, rows: DataFrame, key: str, manifest: str, parts: int) -> list[Range]:
    """The ranges of the manifest; the first one is for rows without a key."""
    path = f"{manifest}/ranges"
    if not is_committed(spark, path):
        low, high = rows.agg(F.min(f"`{key}`"), F.max(f"`{key}`")).first()
        ranges = [] if low is None else _cut(Range(low, high + 1), -(-(high + 1 - low) // parts))
        remove(spark, path)
        table = spark.createDataFrame([(r.low, r.high) for r in ranges], "low long, high long")
        table.write.parquet(path)
    found = spark.read.schema("low long, high long").parquet(path).orderBy("low").collect()
    return [Range(None, None), *(Range(r.low, r.high) for r in found)]


def _holding(found: Range, number: int, count: int, key: Column) -> Column:
    """The rows of a range; the outermost ones have no end."""
    if found.low is None:
        # Without any range the table was empty: then all rows belong here.
        return key.isNull() if count > 1 else F.lit(True)
    above = F.lit(True) if number == 1 else key >= found.low
    below = F.lit(True) if number == count - 1 else key < found.high
    return key.isNotNull() & above & below


def _save_part(rows: DataFrame, target: Target, key: str, number: int) -> None:
    if target.path is not None:
        path = f"{target.path.rstrip('/')}/part={number}"
        save(rows, Target(target.format, {**target.options, "path": path}), "overwrite")
    elif isinstance(target, DocTarget):
        options = {"operationType": "replace", "idFieldList": key}
        save(rows, DocTarget(target.format, {**target.options, **options}, target.schema))
    else:
        save(rows.limit(0), target)  # creates the table for the first range
        save(missing_rows(rows, read_target(rows.sparkSession, target), [key]), target)


def read_parts(spark: SparkSession, target: Target) -> DataFrame:
    """What ``copy_in_parts`` copied, without the number of its part."""
    if target.path is None:
        return read_target(spark, target)
    pattern = f"{target.path.rstrip('/')}/part=*"
    return read_target(spark, Target(target.format, {**target.options, "path": pattern}, target.schema))
