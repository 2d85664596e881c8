"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import Staging, texts_of

Batches = Iterator[pa.RecordBatch]

#: Letters of other scripts that look like Latin ones, and what they are read as.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ɡ": "g",
    "ο": "o", "α": "a", "ι": "i", "ν": "v", "υ": "u", "κ": "k", "τ": "t", "ρ": "p", "χ": "x",
    "ɑ": "a", "ı": "i", "ⅼ": "l", "ｏ": "o", "ａ": "a", "ｅ": "e", "ｉ": "i", "ｓ": "s", "ｔ": "t",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
#: What stands for a letter inside a word.
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l",
}
FOLDED = {ord(k): v for k, v in HOMOGLYPHS.items()}
# Two such signs may follow each other, but a letter must stand on either side.
INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!|]{1,2}(?=[^\W\d_])")
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, digits and signs inside words as letters."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(FOLDED)
    if INSIDE.search(low):
        low = INSIDE.sub(lambda m: "".join(map(SUBSTITUTES.__getitem__, m[0])), low)
    return low


@dataclass(frozen=True)
class Learning:
    """How the lexicon is learned.

    At most about ``sample`` labelled documents are looked at, chosen by a hash of
    their id: all of them while there are no more. Terms are whole words and the
    first ``shortest`` to ``longest`` letters of words; one enters the lexicon if its
    log-odds reach ``odds`` and its likelihood ratio ``evidence``: so high that chance
    alone brings none of some millions of terms that far.
    """

    sample: int = 30_000
    shortest: int = 3
    longest: int = 8
    evidence: float = 30.0
    odds: float = 2.5
    terms: int = 5000
    rounds: int = 200


@dataclass(frozen=True)
class Lexicon:
    """Term weights, exception phrases, and how a sum of weights becomes a score.

    A term ending in ``*`` stands for the words that begin with it, others for
    themselves. A term inside an exception phrase does not count.
    """

    weights: dict[str, float]
    exceptions: Sequence[str] = ()
    intercept: float = -3.0
    slopes: tuple[float, float, float] = (1.0, 1.0, 0.0)


class Matcher:
    """A lexicon made ready for many texts."""

    def __init__(self, lexicon: Lexicon) -> None:
        self._lexicon = lexicon
        self._terms = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            stem = term.rstrip("*")
            entry = (len(stem), weight, term)
            # A stem and a word may be spelled alike.
            entries = self._terms.get(stem, ()) + (entry,)
            self._terms.add_word(stem, entries)
        if len(self._terms):
            self._terms.make_automaton()
        self._phrases = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self._phrases.add_word(phrase, len(phrase))
        if len(self._phrases):
            self._phrases.make_automaton()

    def hits(self, low: str) -> list[tuple[int, float]]:
        """Where in a folded text a word is hit, and its weight: that of its longest term."""
        if not len(self._terms):
            return []
        best: dict[int, tuple[int, float]] = {}
        size = len(low)
        for end, entries in self._terms.iter(low):
            for length, weight, term in entries:
                start = end - length + 1
                if start and low[start - 1].isalpha():
                    continue
                if term[-1] != "*" and end + 1 < size and low[end + 1].isalpha():
                    continue
                if length > best.get(start, (0, 0.0))[0]:
                    best[start] = (length, weight)
        if best and len(self._phrases):
            for end, length in self._phrases.iter(low):
                for start in [s for s in best if end - length < s <= end]:
                    del best[start]
        return [(start, weight) for start, (_, weight) in best.items()]

    def features(self, text: str) -> tuple[float, float, float]:
        """Weights by the square root of the length, different hits, and the mean weight."""
        low = fold(text)
        hits = self.hits(low)
        if not hits:
            return 0.0, 0.0, 0.0
        total = sum(weight for _, weight in hits)
        words = 1 + len(low) / 6
        return (
            total / math.sqrt(words),
            math.log1p(sum(w for _, w in hits if w > 0)),
            total / len(hits),
        )

    def score(self, text: str) -> float:
        z = self._lexicon.intercept + float(
            np.dot(self._lexicon.slopes, self.features(text))
        )
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms_of(low: str, learning: Learning) -> set[str]:
    found: set[str] = set()
    for word in set(WORD.findall(low)):
        found.add(word)
        for n in range(learning.shortest, min(learning.longest, len(word)) + 1):
            found.add(word[:n] + "*")
    return found


def held_out(doc_id: Column) -> Column:
    """Ids whose crc32, as text, leaves 0 when divided by 5."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learn(
    docs: DataFrame, labels: DataFrame, learning: Learning = Learning(), id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> Lexicon:
    """The lexicon that tells the labelled documents apart; held-out ids are not looked at.

    Labels that are null, or of no document, do not count; of a document's labels the
    larger counts. Without toxic labels the lexicon is empty and scores are low.
    """
    marked = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    share = learning.sample / max(1, marked.count())
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # Broadcast within the bound of the sample, a few bytes a document. Copies of a text
    # count once, or their chance words would look like evidence.
    staging = Staging(docs.sparkSession, "toxicity")
    sample = staging.keep(
        texts_of(docs, id_col, text_col)
        .join(F.broadcast(chosen), "doc_id")
        .withColumn("key", F.xxhash64("text"))
        .dropDuplicates(["toxic", "key"])
        .select("toxic", "text")
    )
    sizes = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon({})
    counted = sample.mapInArrow(_count_terms(learning), "term string, toxic long, clean long")
    toxic_share = sizes[1] / (sizes[0] + sizes[1])
    both = F.col("toxic") + F.col("clean")
    ratio = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (both * toxic_share))
        + F.when(F.col("clean") > 0, F.col("clean")).otherwise(0)
        * F.log(F.greatest("clean", F.lit(1)) / (both * (1 - toxic_share)))
    )
    strong = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log(
        (F.col("clean") + 0.5) / (sizes[0] + 1)
    )
    top = (
        counted.groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic > 0")
        .withColumn("odds", strong)
        .where((F.col("odds") >= learning.odds) & (ratio >= learning.evidence))
        .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term")
        .limit(learning.terms)
        .collect()
    )
    weights = _without_echoes({row["term"]: (row["toxic"], row["odds"]) for row in top})
    draft = Lexicon(weights)
    contexts = sample.mapInArrow(_count_contexts(draft), "phrase string, toxic long, clean long")
    exceptions = (
        contexts.groupBy("phrase")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic = 0 AND clean >= 3")
        .orderBy(F.desc("clean"), "phrase")
        .limit(learning.terms)
    )
    lexicon = Lexicon(weights, tuple(row["phrase"] for row in exceptions.collect()))
    lexicon = _calibrated(sample, lexicon, learning)
    staging.drop(sample)
    return lexicon


def _without_echoes(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Leave out terms that a shorter one in the lexicon already covers about as surely."""
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t.rstrip("*")), t)):
        stem, odds = term.rstrip("*"), found[term][1]
        shorter = [kept[stem[:n] + "*"] for n in range(1, len(stem) + 1) if stem[:n] + "*" in kept]
        if not shorter or odds > max(shorter) + 0.7:
            kept[term] = odds
    return kept


def _calibrated(sample: DataFrame, lexicon: Lexicon, learning: Learning) -> Lexicon:
    """Fit intercept and slopes by Newton steps over counts of rounded features."""
    cells = (
        sample.mapInArrow(_features(lexicon), "a double, b double, c double, toxic int")
        .groupBy("a", "b", "c", "toxic")
        .count()
        .collect()
    )
    x = np.array([[1.0, r["a"], r["b"], r["c"]] for r in cells])
    y = np.array([r["toxic"] for r in cells], float)
    n = np.array([r["count"] for r in cells], float)
    theta = np.zeros(4)
    penalty = np.diag([1e-6, 0.1, 0.1, 0.1])
    for _ in range(learning.rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (n * (y - p)) - penalty @ theta
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(4)
        step = np.linalg.solve(curve, slope)
        theta = theta + step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(
        lexicon.weights, lexicon.exceptions, float(theta[0]), tuple(map(float, theta[1:]))
    )


def _tally(counts: dict[int, Counter], names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    terms = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string())]
        + [pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0)],
        list(names),
    )


def _count_terms(learning: Learning):
    def count(batches: Batches) -> Batches:
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[1 if toxic else 0].update(terms_of(fold(text), learning))
            yield from _tally(counts, ("term", "toxic", "clean"))

    return count


def _count_contexts(lexicon: Lexicon):
    def count(batches: Batches) -> Batches:
        matcher = Matcher(lexicon)
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = fold(text)
                phrases = set()
                for start, _ in matcher.hits(low):
                    around = low[max(0, start - 24) : start + 48]
                    at = start - max(0, start - 24)
                    spans = [m.span() for m in WORD.finditer(around)]
                    here = next((i for i, (a, b) in enumerate(spans) if a <= at < b), None)
                    if here is not None:
                        if here:
                            phrases.add(around[spans[here - 1][0] : spans[here][1]])
                        if here + 1 < len(spans):
                            phrases.add(around[spans[here][0] : spans[here + 1][1]])
                counts[1 if toxic else 0].update(phrases)
            yield from _tally(counts, ("phrase", "toxic", "clean"))

    return count


def _features(lexicon: Lexicon):
    def features(batches: Batches) -> Batches:
        matcher = Matcher(lexicon)
        for batch in batches:
            found = [
                tuple(round(v * 4) / 4 for v in matcher.features(t))
                for t in batch.column(1).to_pylist()
            ]
            a, b, c = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v, pa.float64()) for v in (a, b, c)), batch.column(0).cast(pa.int32())],
                ["a", "b", "c", "toxic"],
            )

    return features


def score(
    docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, score`` of every whole text, score from 0 to 1.

    Null and empty texts score like any text without hits. Rows without id and
    repeated rows are scored like any other; no row is shuffled. The lexicon is of
    bounded size and goes to the tasks with the code.
    """

    def scored(batches: Batches) -> Batches:
        matcher = Matcher(lexicon)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([matcher.score(t) for t in texts], pa.float64()),
                ],
                ["doc_id", "score"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(scored, "doc_id long, score double")


def drop_toxic(
    docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The documents with a score below the threshold, with all their columns."""
    place = docs.columns.index(text_col)

    def clean(batches: Batches) -> Batches:
        matcher = Matcher(lexicon)
        for batch in batches:
            keep = [matcher.score(t or "") < threshold for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
