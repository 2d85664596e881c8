"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import Staging

ROUNDS = 60


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (longs): the least node it reaches.

    A large star links the larger neighbours of each node to its least one, a small
    star the smaller ones; both keep the components, and a forest of stars is left.
    The least neighbour is a partial aggregate and the links join it on the node, so
    a hub's links are never gathered. Each round is staged, and no link reaches the
    driver: it sees a count and a checksum.
    """
    current = staging.keep(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u > v")
        .distinct()
    )
    seen = _checksum(current)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        large = _large_star(current)
        following = staging.keep(_small_star(large))
        staging.drop(current)
        current, last, seen = following, seen, _checksum(following)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components still change after {ROUNDS} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u > v").distinct()


def _checksum(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
    ).first()
    return row[0], row[1]
