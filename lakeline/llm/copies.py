"""Exact copies by digest, with the most frequent digests taken out of the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeline.llm.common import Staging, ascii_lower, texts_of

#: Counters of the frequent-items summary; a digest above 3.5 / COUNTERS of all rows is surely
#: among its items.
COUNTERS = 4096
#: Digests looked at as possible heavy hitters, which bounds what is broadcast.
CANDIDATES = 512


def mark_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counters: int = COUNTERS,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; the largest id of a
    group stays. A Misra-Gries summary over the digests, merged from every task,
    names at most ``candidates`` frequent ones. Their exact sizes and winners are
    counted by one aggregation, broadcast (at most ``candidates`` rows), and joined
    where the rows lie, so copies of a frequent text are never shuffled. The other
    groups are below the summary's error, and shuffle by digest.

    Null text is empty text, and empty texts are copies of each other. A row
    without id never wins against one with an id; in a group of none but such rows
    ``keep_id`` is null and all stay. Rows that repeat an id and a text count each
    and share their verdict. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    staging = Staging(spark, "copies")
    digests = staging.keep(
        texts_of(docs, id_col, text_col).select(
            "doc_id", F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest")
        )
    )
    # The summary counts a 64-bit key of each digest; winners are verified on whole digests.
    summary = digests.select(F.xxhash64("digest").alias("key")).agg(
        F.expr(f"approx_top_k(key, {candidates}, {counters})").alias("top")
    )
    frequent = summary.select(F.inline("top")).where(F.col("count") > 1).select(
        F.col("item").alias("_key")
    )
    in_group = [
        F.max("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
    ]
    winners = staging.keep(
        digests.join(F.broadcast(frequent), F.xxhash64("digest") == F.col("_key"), "left_semi")
        .groupBy("digest")
        .agg(*in_group)
    )
    heavy = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    light = digests.join(F.broadcast(winners), "digest", "left_anti").select(
        "digest",
        "doc_id",
        F.max("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    return staging.finish(
        heavy.unionByName(light).select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns.

    Of rows that repeat the winning id and its text any one stays.
    """
    marks = mark_copies(docs, id_col, text_col)
    digest = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256)

    def among(rows: DataFrame, marked: DataFrame, how: str) -> DataFrame:
        keys = marked.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
        same = rows[id_col].cast("long").eqNullSafe(F.col("_id")) & (digest == F.col("_digest"))
        return rows.join(keys, same, how)

    staying = among(docs, marks.where(~F.col("kept")), "left_anti")
    winners = marks.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"))
    repeated = winners.where("rows > 1").drop("rows")
    if repeated.isEmpty():
        return staying
    once = among(staying, repeated, "left_semi").withColumn("_digest", digest)
    once = once.dropDuplicates([id_col, "_digest"]).drop("_digest")
    return among(staying, repeated, "left_anti").unionByName(once)
