"""Near copies: MinHash bands propose, signatures and full shingle sets confirm, components group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import Staging, runs
from lakeline.llm.components import components
from lakeline.llm.shingles import (
    WordHashes,
    alike,
    band_keys,
    digest,
    minima,
    shingle_set,
    universal_family,
)

#: Rows of a bucket whose signatures are compared with each other or with as many others in one
#: piece, and of a cluster whose full sets are.
TILE = 512
EXACT_TILE = 128
#: Documents whose shingle sets a task remembers while it confirms pairs.
SETS = 256


@dataclass(frozen=True)
class Likeness:
    """Word shingles of ``words`` words, alike from a similarity of ``percent`` per cent.

    A pair at the threshold s shares none of the bands with probability
    (1 - s**rows)**bands: 7e-9 at 0.85 and 3e-6 at 0.80 with the defaults. Pairs
    whose signatures agree in less than ``margin`` below the threshold (five
    standard deviations) are not looked at further.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    margin: float = 0.15
    seed: int = 11

    @property
    def least_agreement(self) -> int:
        hashes = self.bands * self.rows
        return int(hashes * (self.percent / 100 - self.margin))


def near_copies(
    docs: DataFrame, likeness: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, text_key``.

    Documents are linked when their sets of word shingles have a similarity of at
    least the threshold, and ``component_id`` is the smallest id that links reach.
    Equal sets stand for one node. Nodes that share a band of minima are candidates.
    Each node is first compared with the bucket hub it shares most bands with, then
    with another one if it is not yet connected with it. In buckets that still hold
    several components, pairs of signatures are compared in tiles of bounded size,
    and as few of the likely ones as connect them are written out: these give
    clusters. Within a cluster every likely pair of different components is compared
    on full sets of whole texts, in tiles again, and only links leave a tile. So
    every pair that shares a band ends up confirmed, refuted or connected through
    others: buckets need no cap, and the pairs of a group are never listed.

    Null text is empty; a text without words has no shingle and is linked with
    nothing. A row without id takes part in no link: its component is null, and it
    is kept. Rows that repeat an id count each, and texts under one id are linked only
    if they are alike; ``text_key``, a hash of the text, tells them apart. However
    often a row is repeated, its text is compared once. An empty table gives an empty
    result.
    """
    staging = Staging(docs.sparkSession, "near")
    raw = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("binary").alias("text"),
        text_key(F.col(text_col)).alias("text_key"),
    )
    signed = staging.keep(
        raw.mapInArrow(
            _sign(likeness),
            "doc_id long, text_key long, n_shingles long, digest binary, signature binary, code binary",
        )
    )
    # One row for each set, whatever the number of rows or ids that hold it.
    nodes = staging.keep(
        signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "text_key")).alias("least"),
            F.first("signature").alias("signature"),
            F.first("code").alias("code"),
        )
        .select("digest", "least.*", "signature", "code")
        .withColumn("node", F.monotonically_increasing_id())
    )
    signatures = nodes.select("node", "signature", "code")
    buckets = signatures.select("node", "signature").mapInArrow(
        _bands(likeness), "bucket long, node long"
    )
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top"))
    members = staging.keep(
        buckets.join(shared.where("hub < top").select("bucket", "hub"), "bucket")
    )
    codes = signatures.select("node", "code")

    def texts_for(ids: DataFrame) -> DataFrame:
        """One text of each node."""
        wanted = nodes.select("node", "doc_id", "text_key").join(ids.distinct(), "node", "left_semi")
        return raw.join(wanted, ["doc_id", "text_key"]).select("node", "text").dropDuplicates(["node"])

    def confirm(pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``u > v`` that are links."""
        likely = staging.keep(
            _side_by_side(pairs, codes, "code").mapInArrow(
                _agreeing(likeness.least_agreement), "u long, v long"
            )
        )
        ids = likely.select(F.col("u").alias("node")).union(likely.select("v"))
        texts = staging.keep(texts_for(ids))
        links = staging.keep(
            _side_by_side(likely, texts, "text").mapInArrow(_linked(likeness), "u long, v long")
        )
        staging.drop(likely, texts)
        return links

    asked = staging.keep(_best_hubs(members))
    links = confirm(asked)
    roots = components(links, staging)
    still = staging.keep(_unsettled(members, roots))
    if not still.isEmpty():
        more = confirm(_best_hubs(still).join(asked, ["u", "v"], "left_anti"))
        links = links.unionByName(more)
        roots = components(links, staging)
        still = staging.keep(_unsettled(members, roots))
    if not still.isEmpty():
        likely = staging.keep(_likely_pairs(still, codes, likeness))
        clusters = components(likely, staging)
        parts = staging.keep(
            still.select("node", "root")
            .distinct()
            .join(clusters.selectExpr("node AS root", "root AS cluster"), "root")
        )
        texts = texts_for(parts.select("node"))
        held = parts.join(codes, "node").join(texts, "node")
        sizes = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
        pieces = _in_pieces(
            held.join(sizes, "cluster"), "cluster", ["root", "code", "text"], EXACT_TILE
        )
        found = pieces.mapInArrow(_pairs_within(likeness, exact=True), "u long, v long")
        links = links.unionByName(staging.keep(found))
        roots = components(links, staging)
    rooted = nodes.select("digest", "doc_id", "node").join(roots, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
    node_of = rooted.join(least, "root").select("digest", "component")
    small = signed.select("doc_id", "text_key", "n_shingles", "digest")
    # Texts without words may be many and need no join.
    alone = small.where("digest IS NULL").withColumn("component", F.col("doc_id"))
    placed = small.where("digest IS NOT NULL").join(node_of, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return staging.finish(
        placed.unionByName(alone).select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.col("doc_id").eqNullSafe(component).alias("kept"),
            "text_key",
        )
    )


def drop_near_copies(
    docs: DataFrame, likeness: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The document with the smallest id of each component, with all its columns."""
    losers = near_copies(docs, likeness, id_col, text_col).where(~F.col("kept"))
    losers = losers.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    same = (docs[id_col].cast("long") == F.col("_id")) & (text_key(docs[text_col]) == F.col("_key"))
    return docs.join(losers, same, "left_anti")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold nodes of more than one component."""
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")
    )
    return placed.join(mixed.where("low < high").select("bucket", "size"), "bucket")


def _best_hubs(members: DataFrame) -> DataFrame:
    """Each node, as ``u``, with the hub ``v`` of most of its buckets, if of another component."""
    if "root" in members.columns:
        hubs = members.where("node = hub").select("bucket", F.col("root").alias("hub_root"))
        members = members.join(hubs.distinct(), "bucket").where("root <> hub_root")
    counts = members.where("node > hub").groupBy("node", "hub").agg(F.count("*").alias("shared"))
    best = F.max_by("hub", F.struct("shared", -F.col("hub")))
    return counts.groupBy("node").agg(best.alias("v")).select(F.col("node").alias("u"), "v")


def _in_pieces(rows: DataFrame, group: str, columns: list[str], tile: int) -> DataFrame:
    """Rows of a group of ``size`` nodes, cut into tiles; each pair of tiles is a piece.

    Rows come sorted by piece, so a piece is read in one go.
    """
    tiles = F.ceil(F.col("size") / tile)
    return (
        rows.withColumn("tiles", tiles)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")).alias("piece"),
            "node",
            *columns,
        )
        .repartition("piece")
        .sortWithinPartitions("piece", "node")
    )


def _likely_pairs(still: DataFrame, codes: DataFrame, likeness: Likeness) -> DataFrame:
    """Pairs of components, as few as connect those with agreeing signatures in a bucket."""
    pieces = _in_pieces(still.join(codes, "node"), "bucket", ["root", "code"], TILE)
    return pieces.mapInArrow(_pairs_within(likeness, exact=False), "u long, v long").distinct()


def _side_by_side(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``u, v`` with the column of both nodes, those of one ``v`` next to each other."""
    of_v = table.select(F.col("node").alias("v"), F.col(column).alias("of_v"))
    of_u = table.select(F.col("node").alias("u"), F.col(column).alias("of_u"))
    return pairs.join(of_v, "v").join(of_u, "u").select("u", "v", "of_u", "of_v")


Batches = Iterator[pa.RecordBatch]


def _sign(likeness: Likeness) -> Callable[[Batches], Batches]:
    def sign(batches: Batches) -> Batches:
        known = WordHashes()
        family = universal_family(likeness.bands * likeness.rows, likeness.seed)
        for batch in batches:
            sizes, digests, signatures, codes = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py() or b"", likeness.words, known)
                sizes.append(len(found))
                least = minima(found, family) if len(found) else None
                digests.append(None if least is None else digest(found))
                signatures.append(None if least is None else least.tobytes())
                codes.append(None if least is None else (least & 0xFF).astype(np.uint8).tobytes())
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64())]
            columns += [pa.array(x, pa.binary()) for x in (digests, signatures, codes)]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "text_key", "n_shingles", "digest", "signature", "code"]
            )

    return sign


def _bands(likeness: Likeness) -> Callable[[Batches], Batches]:
    def bands(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [
                band_keys(np.frombuffer(s.as_py(), np.uint32), likeness.rows)
                for s in batch.column(1)
            ]
            nodes = np.repeat(batch.column(0).to_numpy(), likeness.bands)
            flat = np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(nodes)], ["bucket", "node"])

    return bands


def _agreeing(least: int) -> Callable[[Batches], Batches]:
    def agreeing(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                u, v = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(
                        batch.num_rows, -1
                    )
                    for i in (2, 3)
                )
                yield batch.select([0, 1]).filter(pa.array((u == v).sum(axis=1) >= least))

    return agreeing


def _linked(likeness: Likeness) -> Callable[[Batches], Batches]:
    def linked(batches: Batches) -> Batches:
        known = WordHashes()
        sets: dict[int, tuple[bytes, np.ndarray]] = {}

        def shingles_of(node: int, text: bytes) -> np.ndarray:
            kept = sets.get(node)
            if kept is None or kept[0] != text:
                if len(sets) >= SETS:
                    sets.clear()
                kept = sets[node] = text, shingle_set(text, likeness.words, known)
            return kept[1]

        for batch in batches:
            yes = [
                alike(
                    shingle_set(u_text.as_py() or b"", likeness.words, known),
                    shingles_of(v.as_py(), v_text.as_py() or b""),
                    likeness.percent,
                )
                for v, u_text, v_text in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return linked


def _pairs_within(likeness: Likeness, exact: bool) -> Callable[[Batches], Batches]:
    """Pairs of each piece, as few as connect its components.

    Roots of components whose signatures agree; or, ``exact``, nodes that are linked.
    """
    least = likeness.least_agreement

    def linked_in(piece: pa.Table, known: WordHashes) -> np.ndarray:
        nodes, roots = piece.column("node").to_numpy(), piece.column("root").to_numpy()
        raw = b"".join(piece.column("code").to_pylist())
        codes = np.frombuffer(raw, np.uint8).reshape(len(nodes), -1)
        sets: dict[int, np.ndarray] = {}

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                text = piece.column("text")[i].as_py() or b""
                sets[i] = shingle_set(text, likeness.words, known)
            return sets[i]

        group = np.unique(roots, return_inverse=True)[1]
        found = []
        for i in range(len(nodes) - 1):
            other = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
            near = (codes[other] == codes[i]).sum(axis=1) >= least
            for j in other[near]:
                if group[j] == group[i]:
                    continue
                if not exact:
                    found.append((max(roots[i], roots[j]), min(roots[i], roots[j])))
                elif alike(set_of(i), set_of(j), likeness.percent):
                    found.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
                else:
                    continue
                group[group == group[j]] = group[i]
        return np.array(found, np.int64).reshape(-1, 2)

    def pairs(batches: Batches) -> Batches:
        known = WordHashes()
        for piece in runs(batches, "piece"):
            if piece.num_rows > 1:
                u, v = linked_in(piece, known).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return pairs
