"""Packing documents into token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.bpe import WORDS, Encoder, Vocabulary, read_vocabulary
from lakeline.llm.common import Staging, texts_of

Batches = Iterator[pa.RecordBatch]
ELITES = "array<struct<bins:binary,generations:int>>"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Evolution:
    """How long and how wide the search for a good packing is.

    Pieces are dealt at random to blocks of about ``block`` pieces. Every block is
    packed by ``islands`` populations, which begin with packings in random order and
    exchange their best one between ``epochs`` of ``generations``. The worst ``rework`` of a block's bins are emptied and packed anew
    with those of other blocks, until one block holds them.
    """

    block: int = 8192
    islands: int = 3
    epochs: int = 2
    generations: int = 10
    population: int = 4
    rework: float = 0.02
    seed: int = 5


def pieces(
    docs: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's pieces.

    A document is its ids and a closing id 0. Longer ones than ``capacity`` are cut
    into pieces of that length, of which the first may be shorter.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def cut(batches: Batches) -> Batches:
        voc = Vocabulary(source.value)
        encoding = tiktoken.Encoding(
            "own", pat_str=WORDS, mergeable_ranks=voc.ids, special_tokens=voc.special
        )
        walker = Encoder(voc)

        def ids_of(text: str) -> np.ndarray:
            try:
                return encoding.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its patterns give up on very long runs of blanks
                return walker([text])[0]

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py()), 0).astype("<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for i, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    crc = zlib.crc32(ids[start:end].tobytes())
                    rows.append((doc_id, i, start, end - start, crc))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                [field.split()[0] for field in PIECE.split(", ")],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(cut, PIECE)


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    evolution: Evolution = Evolution(),
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """The pieces of ``pieces``, each with ``sequence_id``, its ``offset`` there and ``generations``.

    Sequences hold at most ``capacity`` tokens without gaps. Full pieces are
    sequences of their own; the others are packed block by block, see ``Evolution``.
    A block's search ends early where no packing has fewer sequences. ``generations``
    are those that its packing descends from, 0 if crossover had no part in it.

    Null and empty texts are one token, the closing one. Rows without id and
    repeated rows are packed like any other. An empty table gives an empty result.
    """
    staging = Staging(docs.sparkSession, "packing")
    all_pieces = staging.keep(pieces(docs, capacity, id_col, text_col, vocabulary))
    full = all_pieces.where(F.col("length") == capacity).select(
        "*",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(0).alias("generations"),
    )
    result = full
    rest = all_pieces.where(F.col("length") < capacity)
    count, level = rest.count(), 0
    while count:
        blocks = -(-count // evolution.block)
        packed = _pack_blocks(rest, blocks, level, capacity, evolution, staging)
        last = blocks == 1
        done = packed if last else packed.where(~F.col("poor"))
        result = result.unionByName(done.drop("poor"))
        if last:
            break
        rest = packed.where("poor").drop("poor", "sequence_id", "offset", "generations")
        before, count, level = count, rest.count(), level + 1
        if count >= before:
            raise RuntimeError("reworked bins must become fewer")
    return staging.finish(result)


def _pack_blocks(
    rest: DataFrame, blocks: int, level: int, capacity: int, evolution: Evolution, staging: Staging
) -> DataFrame:
    dealt = rest.withColumn("block", F.floor(F.rand(evolution.seed + level) * blocks))
    fields = [field.split()[0] for field in PIECE.split(", ")]
    held = staging.keep(
        dealt.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("items"))
    )
    islands = F.explode(F.sequence(F.lit(0), F.lit(evolution.islands - 1))).alias("island")
    tasks = held.select("block", islands, F.col("items.length").alias("lengths"))
    elites: DataFrame | None = None
    for epoch in range(evolution.epochs):
        if elites is None:
            state = tasks.withColumn("elites", F.array().cast(ELITES))
        else:
            # An island goes on from its own best packing and from its neighbour's.
            visiting = elites.withColumn("island", F.pmod(F.col("island") + 1, evolution.islands))
            own = elites.unionByName(visiting)
            state = tasks.join(
                own.groupBy("block", "island").agg(F.collect_list(F.struct("bins", "generations")).alias("elites")),
                ["block", "island"],
            )
        spread = state.repartition(blocks * evolution.islands, "block", "island")
        elites = staging.keep(
            spread.mapInArrow(
                _evolve(capacity, evolution, level * 1000 + epoch),
                "block long, island int, cost double, bins binary, generations int",
            )
        )
    best = elites.groupBy("block").agg(
        F.min_by(F.struct("bins", "generations"), F.struct("cost", "island")).alias("best")
    ).select("block", "best.*")
    schema = f"{PIECE}, sequence_id long, offset long, generations int, poor boolean"
    placed = held.join(best, "block").mapInArrow(_place(level, capacity, evolution.rework), schema)
    return staging.keep(placed)


def _evolve(capacity: int, evolution: Evolution, salt: int) -> Callable[[Batches], Batches]:
    def evolve(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                block, island = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                lengths = np.array(batch.column(2)[row].values.to_numpy(), np.int64)
                random = np.random.default_rng([evolution.seed, salt, block, island])
                search = Search(lengths, capacity, random)
                elites = [
                    (np.frombuffer(e["bins"], np.int32), e["generations"])
                    for e in batch.column(3)[row].as_py()
                ]
                bins, bred = search.run(elites, evolution.population, evolution.generations)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([block], pa.int64()),
                        "island": pa.array([island], pa.int32()),
                        "cost": pa.array([search.cost(bins)], pa.float64()),
                        "bins": pa.array([bins.astype(np.int32).tobytes()], pa.binary()),
                        "generations": pa.array([bred], pa.int32()),
                    }
                )

    return evolve


class Search:
    """Packings of one block: arrays with the bin of every item, bins from 0."""

    def __init__(self, lengths: np.ndarray, capacity: int, random: np.random.Generator) -> None:
        self.lengths = lengths
        self.capacity = capacity
        self.random = random

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths)

    def cost(self, bins: np.ndarray) -> float:
        """Bins, and below one bin how unevenly they are filled: uneven is better."""
        fills = self.fills(bins) / self.capacity
        return len(fills) + 1 - float(np.mean(fills**2))

    def best_fit(self, bins: np.ndarray, items: np.ndarray, used: int) -> np.ndarray:
        """Put the items, in their order, each into the fullest bin that has room.

        ``bins`` holds -1 for items that have none yet; ``used`` bins are open.
        """
        bins = bins.copy()
        placed = bins >= 0
        room = self.capacity - np.bincount(bins[placed], self.lengths[placed], used).astype(int)
        with_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_rooms = 0  # bit r: some bin has room r
        for bin_, r in enumerate(room.tolist()):
            with_room[r].append(bin_)
            open_rooms |= 1 << r
        for item, length in zip(items.tolist(), self.lengths[items].tolist(), strict=True):
            fitting = open_rooms >> length
            if fitting:
                r = length + (fitting & -fitting).bit_length() - 1
                bin_ = with_room[r].pop()
                if not with_room[r]:
                    open_rooms ^= 1 << r
            else:
                r, bin_, used = self.capacity, used, used + 1
            bins[item] = bin_
            with_room[r - length].append(bin_)
            open_rooms |= 1 << (r - length)
        return bins

    def fresh(self) -> np.ndarray:
        """Best fit of the items in random order."""
        order = self.random.permutation(len(self.lengths))
        return self.best_fit(np.full(len(self.lengths), -1), order, 0)

    def cross(self, mother: np.ndarray, father: np.ndarray) -> np.ndarray:
        """The mother's bins with well-filled ones of the father put in whole.

        Her bins that hold an item of those are taken apart, as are many that are not
        full and some that are, or the same packing would come back. Their other
        items are best-fitted again, more or less the longest first.
        """
        fills = self.fills(father)
        good = np.flatnonzero(fills >= 0.999 * self.capacity)
        if not len(good):
            good = np.argsort(-fills)[: max(1, len(fills) // 4)]
        chosen = np.zeros(len(fills), bool)
        chosen[good[self.random.random(len(good)) < self.random.uniform(0.1, 0.6)]] = True
        injected = chosen[father]
        own = self.fills(mother)
        of_full, of_others = self.random.uniform(0, 0.5), self.random.uniform(0.3, 1.2)
        share = np.where(own < self.capacity, of_others, of_full)
        broken = self.random.random(len(own)) < share
        broken[mother[injected]] = True
        lost = broken[mother]
        bins = np.where(lost, -1, mother)
        bins[injected] = father[injected] + len(own)
        held = bins >= 0
        bins[held] = np.unique(bins[held], return_inverse=True)[1]
        displaced = np.flatnonzero(~held)
        blur = self.random.uniform(0, 0.02 if self.random.random() < 0.7 else 0.5)
        blurred = self.lengths[displaced] * (1 + blur * self.random.random(len(displaced)))
        used = int(bins.max()) + 1 if held.any() else 0
        return self.best_fit(bins, displaced[np.argsort(-blurred)], used)

    def run(
        self, elites: list[tuple[np.ndarray, int]], population: int, generations: int
    ) -> tuple[np.ndarray, int]:
        """The best packing and how many generations it descends from; so with ``elites``."""
        people = [(self.cost(packing), bred, packing) for packing, bred in elites]
        while len(people) < population:
            packing = self.fresh()
            people.append((self.cost(packing), 0, packing))
        least = -(-int(self.lengths.sum()) // self.capacity)
        for _ in range(generations):
            people.sort(key=lambda p: p[:2])
            if int(people[0][0]) <= least:
                break  # no packing has fewer bins
            children = []
            for _ in range(population):
                a, b = sorted(self.random.choice(len(people), 2, replace=False))
                child = self.cross(people[a][2], people[b][2])
                children.append((self.cost(child), 1 + max(people[a][1], people[b][1]), child))
            people = sorted(people + children, key=lambda p: p[:2])[:population]
        _, bred, packing = min(people, key=lambda p: p[:2])
        return packing, bred


def _place(level: int, capacity: int, rework: float) -> Callable[[Batches], Batches]:
    def place(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                items = batch.column("items")[row].values
                bins = np.frombuffer(batch.column("bins")[row].as_py(), np.int32)
                order = np.argsort(bins, kind="stable")
                sorted_bins = bins[order]
                lengths = items.field("length").to_numpy()[order]
                fills = np.bincount(bins, items.field("length").to_numpy())
                before = np.cumsum(lengths) - lengths
                offset = before - (np.cumsum(fills) - fills)[sorted_bins].astype(np.int64)
                poor = np.zeros(len(fills), bool)
                worst = np.argsort(fills, kind="stable")[: 1 + int(rework * len(fills))]
                poor[worst[fills[worst] < capacity]] = True
                sequence = (level << 56) + (block << 24) + sorted_bins.astype(np.int64)
                moved = items.take(pa.array(order))
                fields = {f.name: moved.field(f.name) for f in moved.type}
                yield pa.RecordBatch.from_pydict(
                    fields
                    | {
                        "sequence_id": pa.array(sequence),
                        "offset": pa.array(offset),
                        "generations": pa.repeat(batch.column("generations")[row], len(order)),
                        "poor": pa.array(poor[sorted_bins]),
                    }
                )

    return place
