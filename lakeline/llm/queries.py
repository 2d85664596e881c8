"""Every operator of this subpackage as a query over the given tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.llm.bpe import decode, encode
from lakeline.llm.common import read_table
from lakeline.llm.conversations import digest_turns, repair_conversations
from lakeline.llm.copies import mark_copies
from lakeline.llm.leaks import find_leaks
from lakeline.llm.licences import find_licences
from lakeline.llm.near_copies import Likeness, near_copies
from lakeline.llm.oracle import ORACLE
from lakeline.llm.packing import pack
from lakeline.llm.passages import shared_passages
from lakeline.llm.personal_data import KINDS, find_spans
from lakeline.llm.repeats import find_repeats
from lakeline.llm.topk import top_k
from lakeline.llm.toxicity import held_out, learn, score
from lakeline.llm.url_rules import judge_urls

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


@register
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


@register
def op3_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(read_table(spark, sf_dir, "documents"))


@register
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(read_table(spark, sf_dir, "documents"))


@register
def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licences(read_table(spark, sf_dir, "documents"))


@register
def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(read_table(spark, sf_dir, "documents")))
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


@register
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read_table(spark, sf_dir, "documents"))
    counts = [_count_of(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans")
    )


def _count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")


def _listed(spans: str) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lexicon = learn(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, lexicon).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@register
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    likeness = Likeness(words=3, percent=85)
    return near_copies(read_table(spark, sf_dir, "documents"), likeness).drop("text_key")


def with_loops(docs: DataFrame) -> DataFrame:
    """The documents, of which one in ten repeats a stretch of its words up to the end."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    looped = docs.withColumns({"hash": hashed, "words": F.when(hashed % 10 == 0, words)})
    looped = looped.withColumns({"n": F.size("words"), "g": F.floor(F.col("hash") / 10)})
    looped = looped.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    looped = looped.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    text = F.expr(
        "array_join(transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])), ' ')"
    )
    return looped.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@register
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(with_loops(read_table(spark, sf_dir, "documents")))
    # Greatest exponent first, compared as an exact fraction.
    order = """(l, r) -> CASE
        WHEN l.length * r.period <> r.length * l.period
        THEN if(l.length * r.period > r.length * l.period, -1, 1)
        WHEN l.start <> r.start THEN if(l.start < r.start, -1, 1)
        ELSE if(l.period < r.period, -1, 1) END"""
    ranked = found.withColumn("best", F.get(F.expr(f"array_sort(runs, {order})"), F.lit(0)))
    listed = F.array_join(
        F.transform(
            "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
        ),
        "",
    )
    return ranked.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of which some are lost, emptied, cut, repeated or given to the user, with ``copy``."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id",
        "turn",
        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.crc32(named.cast("binary")) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "")
    text = text.when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("fault <> 0").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    )


@register
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    repair = repair_conversations(damaged(conversations), copy_col="copy")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    own = conversations.select(F.col("conv_id").alias("id")).distinct()
    same = F.col("id").eqNullSafe(F.col("conv_id"))
    digests = digest_turns(repair.turns)
    found = own.join(repair.audits, same, "left").drop("conv_id").join(digests, same, "left")
    return found.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@register
def op13_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
