"""Exact top-k search by inner product, reading sorted lists and never a single component."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeline.llm.common import Staging, runs

Batches = Iterator[pa.RecordBatch]
#: Vectors and queries that meet in one piece of work.
VECTORS = 8192
QUERIES = 2048
#: Shares of the lists that have been read when bounds are looked at.
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16)
LONG = (-(1 << 63), (1 << 63) - 1)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score, depth``: the k rows with the highest scores for each query.

    A vector's components are taken as floor(``scale`` * x). The score is the inner
    product; ties go to the smaller id. Candidates are all rows but those with the
    query's id, and ``is_query`` says which rows are queries.

    Vectors and queries are dealt to blocks of bounded size, and every block of
    queries meets every block of vectors once. In a block, each component is a list
    sorted by its value. The lists are read chunk by chunk from the end that a query's
    sign prefers, and never by key: what is unread lies between the last value read and
    the end of its list, which bounds each score from both sides. A query stops when few
    others can still reach the k-th lower bound; the scores of those are then resolved,
    and what no query of the block has asked for is never read. Blocks give k rows a
    query, and the best of all stay. ``depth`` is the largest share of a list that the
    query read in the blocks that gave it these rows.

    Null vectors, and those with null or non-finite components, take no part, nor do
    rows without id. Vectors of different length are not compared; empty ones score
    0. Of rows that repeat an id, the smallest vector of each length counts. Scores
    beyond the range of a long are cut to it. A query without candidates has no row.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    staging = Staging(spark, "topk")
    rows = staging.keep(
        vectors.where(F.col(id_col).isNotNull() & vector.isNotNull() & finite).select(
            F.col(id_col).cast("long").alias("vec_id"),
            vector.alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("query"),
        )
    )
    counts = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("query").cast("int")), F.lit(0))).first()
    vector_blocks, query_blocks = -(-counts[0] // VECTORS) or 1, -(-counts[1] // QUERIES) or 1
    dealt = F.xxhash64("vec_id")
    as_vector = rows.select(
        F.pmod(dealt, F.lit(vector_blocks)).alias("vector_block"),
        _each(query_blocks).alias("query_block"),
        F.lit(False).alias("query"), "vec_id", "vector",
    )
    as_query = rows.where("query").select(
        _each(vector_blocks).alias("vector_block"),
        F.pmod(dealt, F.lit(query_blocks)).alias("query_block"),
        F.lit(True).alias("query"), "vec_id", "vector",
    )
    pieces = (
        as_vector.unionByName(as_query)
        .withColumn("piece", F.xxhash64("vector_block", "query_block", F.size("vector")))
        .select("piece", "query", "vec_id", "vector")
        .repartition(max(2, vector_blocks * query_blocks), "piece")
        .sortWithinPartitions("piece", "query", "vec_id", "vector")
    )
    found = pieces.mapInArrow(_search(k, scale), "query_id long, vec_id long, score long, read double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    deepest = F.max("read").over(Window.partitionBy("query_id")).alias("depth")
    return staging.finish(ranked.select("query_id", "rank", "vec_id", "score", deepest))


def _each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))


def _search(k: int, scale: int) -> Callable[[Batches], Batches]:
    def search(batches: Batches) -> Batches:
        for piece in runs(batches, "piece"):
            is_query = piece.column("query").to_numpy()
            split = int(np.argmax(is_query)) if is_query.any() else len(is_query)
            if 0 < split < len(is_query):
                candidates = _matrix(piece.slice(0, split), scale)
                queries = _matrix(piece.slice(split), scale)
                found = no_random_access(*queries, *candidates, k)
                names = ["query_id", "vec_id", "score", "read"]
                kinds = [*[pa.int64()] * 3, pa.float64()]
                arrays = [pa.array(c, kind) for c, kind in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return search


def _matrix(rows: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, the first row of each, and their scaled components as exact numbers."""
    ids = rows.column("vec_id").to_numpy()
    lists = rows.column("vector").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    scaled = flat.reshape(len(ids), -1)
    first = np.r_[True, ids[1:] != ids[:-1]]
    with np.errstate(over="ignore"):
        product = np.floor(scale * scaled[first])
    if not np.isfinite(product).all():  # beyond the range of a double
        product = np.array(
            [[int(x) * scale for x in row] for row in scaled[first]], object
        ).reshape(product.shape)
    return ids[first], product


def _exactly(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as the fastest kind of number in which all sums of products are exact."""
    if q.dtype != object and x.dtype != object:
        largest = [float(np.abs(m).max(initial=0.0)) for m in (q, x)]
        bound = largest[0] * largest[1] * max(1, q.shape[1])
        for kind, limit in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
            if bound < limit:
                return q.astype(kind), x.astype(kind)
    whole = np.vectorize(int, otypes=[object])
    return tuple(whole(m) if m.size else m.astype(object) for m in (q, x))


class Lists:
    """Each component of the rows as a list sorted by value, read from both ends in chunks.

    A weight above 0 reads its list from the top down, one below 0 from the bottom up.
    ``at_most`` and ``at_least`` hold for each of the two what the values can be: a value
    that is read is known, any other lies between the last one read and the list's end.
    """

    def __init__(self, x: np.ndarray) -> None:
        self._order = np.argsort(x, axis=0, kind="stable")
        self._sorted = np.take_along_axis(x, self._order, 0)
        low, high = (np.broadcast_to(self._sorted[end], x.shape) for end in (0, -1))
        self.at_most = {"down": high.copy(), "up": high.copy()}
        self.at_least = {"down": low.copy(), "up": low.copy()}
        self.depth = 0

    def read(self, depth: int) -> None:
        """Go on from both ends until ``depth`` values of each list are read."""
        rows = len(self._order)
        self._know("down", slice(rows - depth, rows - self.depth))
        self._know("up", slice(self.depth, depth))
        self._bound(self.at_most["down"], slice(0, rows - depth), self._sorted[rows - depth])
        self._bound(self.at_least["up"], slice(depth, rows), self._sorted[depth - 1])
        self.depth = depth

    def _know(self, way: str, chunk: slice) -> None:
        for bound in (self.at_most[way], self.at_least[way]):
            np.put_along_axis(bound, self._order[chunk], self._sorted[chunk], 0)

    def _bound(self, bound: np.ndarray, unread: slice, last: np.ndarray) -> None:
        np.put_along_axis(bound, self._order[unread], last[None, :], 0)

    def upper(self, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
        return positive @ self.at_most["down"].T + negative @ self.at_least["up"].T

    def lower(self, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
        return positive @ self.at_least["down"].T + negative @ self.at_most["up"].T


def no_random_access(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of queries, of their k best vectors, the scores, and the share of its lists a query read."""
    q, x = _exactly(queries, vectors)
    rows = len(ids)
    positive, negative = np.maximum(q, 0), np.minimum(q, 0)
    own = np.searchsorted(ids, query_ids)
    own = np.where((own < rows) & (ids[np.minimum(own, rows - 1)] == query_ids), own, -1)
    active = np.arange(len(q))
    share = np.ones(len(q))
    few = max(4 * k, rows // 64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    lists = Lists(x) if rows > max(few, k) else None
    for depth in DEPTHS if lists else ():
        lists.read(max(lists.depth, 1, int(depth * rows)))
        upper = lists.upper(positive[active], negative[active])
        lower = lists.lower(positive[active], negative[active])
        mine = own[active]
        has_own = np.flatnonzero(mine >= 0)
        beyond = x.dtype.type(-np.inf) if x.dtype != object else -(1 << 2000)
        upper[has_own, mine[has_own]] = beyond
        lower[has_own, mine[has_own]] = beyond
        kth = np.sort(lower, axis=1)[:, -k] if x.dtype == object else np.partition(lower, -k, axis=1)[:, -k]
        may = (upper >= kth[:, None]) & (upper > beyond)
        done = may.sum(axis=1) <= few
        at, column = np.nonzero(may[done])
        pairs.append((active[done][at], column))
        share[active[done]] = lists.depth / rows
        active = active[~done]
        if not len(active):
            break
    for row in active:  # lists read to their ends
        columns = np.flatnonzero(np.arange(rows) != own[row])
        pairs.append((np.full(len(columns), row), columns))
    row, column = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (own[:0], own[:0])
    return _resolved(row, column, q, x, query_ids, ids, k, share)


def _resolved(row, column, q, x, query_ids, ids, k, share):
    """The k best of the pairs left, by their final scores."""
    kept: list[tuple[np.ndarray, ...]] = []
    # Pairs of one query stand together, so a cut between queries loses nothing.
    edges = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else np.zeros(1, int)
    step = 4096
    for i in range(0, len(edges) - 1, step):
        part = slice(edges[i], edges[min(i + step, len(edges) - 1)])
        r, c = row[part], column[part]
        scores = np.array([0] * len(r), object) if x.dtype == object else np.empty(len(r))
        for j in range(0, len(r), 1 << 16):
            block = slice(j, j + (1 << 16))
            scores[block] = (q[r[block]].astype(scores.dtype) * x[c[block]]).sum(axis=1)
        order = np.lexsort((ids[c], np.array([-s for s in scores], scores.dtype), r))
        r, c, scores = r[order], c[order], scores[order]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        top = place < k
        cut = [min(max(int(s), LONG[0]), LONG[1]) for s in scores[top]]
        kept.append((query_ids[r[top]], ids[c[top]], np.array(cut, np.int64), share[r[top]]))
    if not kept:
        return (*[np.empty(0, np.int64)] * 3, np.empty(0))
    return tuple(np.concatenate(p) for p in zip(*kept, strict=True))
