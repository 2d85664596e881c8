"""JSON files of any layout, one-line arrays among them, read by many tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakeline.schemas import DAMAGED, READING

Batches = Iterator[pa.RecordBatch]

#: A JSON string; one that has no end goes on in the next piece.
_STRING = re.compile(rb'"(?:[^"\\]|\\.)*"', re.DOTALL)
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*"', re.DOTALL)
_BETWEEN = b" \t\r\n,[]"
_SPLIT = "file string, block long"


def read_json_objects(
    spark: SparkSession,
    path: str,
    schema: StructType = READING,
    glob: str = "*.json",
) -> DataFrame:
    """The objects of JSON files, whether one a line, or in arrays, over lines or on a single one.

    The columns of ``schema``, and of what does not fit it the text in ``_damaged``, where a
    line of readers of JSON lines would stand. Objects within objects belong to the outer one.
    """
    objects = json_objects(spark, path, glob)
    damaged = StructType([*schema.fields, StructField(DAMAGED, StringType())])
    parsed = F.from_json("value", damaged, {"columnNameOfCorruptRecord": DAMAGED})
    return objects.select(parsed.alias("row")).select("row.*")


def read_json_readings(
    spark: SparkSession, path: str, schema: StructType = READING, glob: str = "*.json"
) -> DataFrame:
    """Readings of a lake's JSON files of any layout, without those that are damaged."""
    return read_json_objects(spark, path, schema, glob).where(F.col(DAMAGED).isNull()).drop(DAMAGED)


def json_objects(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """The text of each outermost object in ``value``; other text between them is a row of its own.

    The files are read as pieces that end at each ``}``, so Spark splits even a file of one
    line between tasks. Where a split begins, it is not known whether within a string
    or how deep within objects. So a first pass finds, for both cases, what each split
    does to them; composed in order they give the state in which every split begins. A
    second pass cuts each split into objects, and parts of an object at the ends of
    splits are put together again. Only those parts are shuffled. Objects that hold a
    ``}`` in a string or an object within are put together from their pieces.

    One row for each split reaches the driver and goes back to the tasks: 50 MB for
    100 TB in splits of 128 MB.
    """
    pieces = (
        spark.read.option("lineSep", "}")
        .option("pathGlobFilter", glob)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_size").alias("size"),
            F.col("value").cast("binary").alias("piece"),
        )
    )
    effects = pieces.mapInArrow(
        _effects, f"{_SPLIT}, size long, read long, outside array<long>, inside array<long>"
    )
    starts = _starts(effects)
    held = spark.sparkContext.broadcast(starts)
    cut = pieces.mapInArrow(_cut(held), f"{_SPLIT}, part string, value binary")
    whole = cut.where("part = 'whole'").select(F.col("value").cast("string"))
    return whole.unionByName(_joined(cut.where("part <> 'whole'")))


def _starts(effects: DataFrame) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """Whether each split begins within a string, how deep within objects, and ends with a ``}``.

    Only the last piece of a file may end without one, which shows in the file's size.
    """
    starts: dict[tuple[str, int], tuple[bool, int, bool]] = {}
    file, within, depth, read = None, False, 0, 0
    for row in effects.orderBy("file", "block").toLocalIterator():
        if row.file != file:
            file, within, depth, read = row.file, False, 0, 0
        read += row.read
        starts[row.file, row.block] = (within, depth, read <= row.size)
        ends_within, change, low = row.inside if within else row.outside
        within, depth = bool(ends_within), max(depth + change, change - low)
    return starts


def _joined(parts: DataFrame) -> DataFrame:
    """Objects from parts of successive splits: a tail, whole splits within, and a head."""
    order = Window.partitionBy("file").orderBy("block", F.col("part") == "tail")
    # A tail begins an object; what follows up to the next tail belongs to it.
    begun = F.sum((F.col("part") == "tail").cast("int")).over(order)
    numbered = parts.withColumn("number", begun)
    texts = F.array_sort(F.collect_list(F.struct("block", F.hex("value").alias("hex"))))
    grouped = numbered.groupBy("file", "number").agg(texts.alias("parts"))
    text = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")).cast("string")
    return grouped.select(text.alias("value")).where(F.trim(F.translate("value", "\t\r\n,[]", "")) != "")


def _text_after(piece: bytes, within: bool) -> tuple[bytes, bool]:
    """The piece without strings, and whether it ends within one."""
    if within:
        end = _STRING_END.match(piece)
        if end is None:
            return b"", True
        piece = piece[end.end() :]
    plain = _STRING.sub(b"", piece)
    at = plain.find(b'"')
    return (plain, False) if at < 0 else (plain[:at], True)


def _by_split(batches: Batches) -> Iterator[tuple[tuple[str, int], int, bytes]]:
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("file", "block", "size", "piece"))
        for file, block, size, piece in zip(*columns, strict=True):
            yield (file, block), size, piece or b""


def _effects(batches: Batches) -> Batches:
    """What a split does, if it begins outside a string or inside one.

    That is: whether it ends within one, the change of depth, and the least change on
    the way, below which a depth cannot fall as it ends at 0.
    """
    found: dict[tuple[str, int], list] = {}
    for split, size, piece in _by_split(batches):
        held = found.setdefault(split, [size, 0, [False, 0, 0], [True, 0, 0]])
        held[1] += len(piece) + 1
        for case in held[2:]:
            plain, case[0] = _text_after(piece, case[0])
            case[1] += plain.count(b"{") - (not case[0])
            case[2] = min(case[2], case[1])
    if found:
        files, blocks = zip(*found, strict=True)
        sizes, read, outside, inside = zip(*found.values(), strict=True)
        numbers, kind = pa.int64(), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(files, pa.string()),
                *[pa.array(x, numbers) for x in (blocks, sizes, read)],
                *[pa.array([[int(x) for x in case] for case in cases], kind) for cases in (outside, inside)],
            ],
            ["file", "block", "size", "read", "outside", "inside"],
        )


def _cut(held) -> Callable[[Batches], Batches]:
    """Objects that lie whole in a split, and the head and tail of those that do not."""

    def cut(batches: Batches) -> Batches:
        starts = held.value
        split: tuple[str, int] | None = None
        within, depth, first = False, 0, False
        open_pieces: list[bytes] = []
        rows: list[tuple[str, int, str, bytes]] = []

        def leave() -> None:
            """What is open at the end of a split goes on in the next one, or is all of this one."""
            if split is not None and open_pieces:
                rows.append((*split, "middle" if first else "tail", b"".join(open_pieces)))

        for own, piece, closed in closing(_by_split(batches), starts):
            if own != split:
                leave()
                split, open_pieces = own, []
                within, depth, _ = starts[split]
                # An object may have begun in the split before.
                first = depth > 0 or within
            if depth == 0 and not within:
                # Between objects: what stands in front of the next one is none of them.
                begin = piece.find(b"{")
                front = piece if begin < 0 else piece[:begin]
                if front.strip(_BETWEEN):
                    rows.append((*split, "whole", front.strip(_BETWEEN)))
                    front = b""
                piece = piece[len(front) :] if begin < 0 else piece[begin:]
                if begin < 0:
                    if closed:
                        rows.append((*split, "whole", b"}"))
                    continue
            plain, within = _text_after(piece, within)
            depth += plain.count(b"{") - (closed and not within)
            open_pieces.append(piece + (b"}" if closed else b""))
            if depth <= 0 and not within:
                depth = 0
                rows.append((*split, "head" if first else "whole", b"".join(open_pieces)))
                open_pieces, first = [], False
            if len(rows) >= 4096:
                yield _rows(rows)
                rows = []
        leave()
        yield _rows(rows)

    return cut


def closing(
    pieces: Iterator[tuple[tuple[str, int], int, bytes]],
    starts: dict[tuple[str, int], tuple[bool, int, bool]],
) -> Iterator[tuple[tuple[str, int], bytes, bool]]:
    """Each piece, and whether a ``}`` ended it."""
    held: tuple[tuple[str, int], bytes] | None = None
    for split, _, piece in pieces:
        if held is not None:
            yield *held, held[0] == split or starts[held[0]][2]
        held = (split, piece)
    if held is not None:
        yield *held, starts[held[0]][2]


def _rows(rows: list[tuple[str, int, str, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "part", "value"]
    )
