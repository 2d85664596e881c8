"""Judging urls by host rules and a weighted vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: rule and what it says.
RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}
STRICT_TERMS = ("porn", "xxx", "spam-farm", "casino", "cheap-pills", "ads-track")
SOFT_TERMS = (
    "adult", "ads", "bet", "bets", "cheap", "free", "pills", "spam", "sex", "track", "viagra",
    "win", "winner",
)
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
TO_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}

VERDICTS = (
    "host string, path string, rule string, verdict string, strict_hits int, soft_hits int"
)


@dataclass(frozen=True)
class Vocabulary:
    """One strict term rejects, and so do ``soft_limit`` different soft ones.

    A term counts where no ASCII letter or digit stands beside it. Terms and urls
    are compared with A-Z lower-cased.
    """

    strict: Sequence[str] = STRICT_TERMS
    soft: Sequence[str] = SOFT_TERMS
    soft_limit: int = 2


@dataclass
class Judge:
    """Rules and vocabulary made ready for many urls."""

    rules: Mapping[str, str]
    vocabulary: Vocabulary
    _by_host: dict[str, list[tuple[str, str, str]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for rule, verdict in self.rules.items():
            host, slash, path = rule.partition("/")
            self._by_host.setdefault(host, []).append((slash + path, rule, verdict))
        self._terms = ahocorasick.Automaton()
        for terms, strict in ((self.vocabulary.soft, False), (self.vocabulary.strict, True)):
            for term in terms:
                self._terms.add_word(term, (term, strict))
        if len(self._terms):
            self._terms.make_automaton()

    def parts(self, url: str | None) -> tuple[str, str]:
        found = URL.search(url) if url else None
        return (found[1].translate(TO_LOWER), found[2]) if found else ("", "")

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits; of equally long ones that with the longer host."""
        best: tuple[int, int, str, str] | None = None
        suffix = host
        while suffix:
            for prefix, rule, verdict in self._by_host.get(suffix, ()):
                if path.startswith(prefix):
                    best = max(best or (0, 0, "", ""), (len(rule), len(suffix), rule, verdict))
            suffix = suffix.partition(".")[2]
        return best[2:] if best else (None, None)

    def hits(self, url: str | None) -> tuple[int, int]:
        """How many different strict and soft terms the url holds."""
        if not url or not len(self._terms):
            return 0, 0
        text = url.translate(TO_LOWER)
        found = set()
        for end, (term, strict) in self._terms.iter(text):
            start = end - len(term)
            beside = text[max(start, 0) : start + 1] + text[end + 1 : end + 2]
            if not any(c.isascii() and c.isalnum() for c in beside):
                found.add((term, strict))
        strict_hits = sum(strict for _, strict in found)
        return strict_hits, len(found) - strict_hits

    def __call__(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = self.parts(url)
        rule, verdict = self.rule(host, path)
        strict_hits, soft_hits = self.hits(url)
        if verdict is None:
            rejected = strict_hits or soft_hits >= self.vocabulary.soft_limit
            verdict = "block" if rejected else "allow"
        return host, path, rule, verdict, strict_hits, soft_hits


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Mapping[str, str] = RULES,
    vocabulary: Vocabulary = Vocabulary(),
) -> DataFrame:
    """``page_id`` and the verdict on every url: its rule's, else the vocabulary's.

    A rule is a host, a slash and the start of a path. It fits its host and all
    subdomains; the longest that fits wins. Rules and terms are parameters and go
    to the tasks with the code, so they must be few; a url is looked up by the
    suffixes of its host, whatever the number of rules.

    A null url, or one without ``://``, has an empty host and path and so no rule;
    the vocabulary judges the whole url, and allows a null one. Rows without id
    and repeated rows are judged like any other. No row is shuffled.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules, vocabulary)
        for batch in batches:
            columns = list(zip(*map(judge, batch.column(1).to_pylist()), strict=True))
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            values = [pa.array(c, k) for c, k in zip(columns or [()] * 6, kinds, strict=True)]
            names = [name.split()[0] for name in VERDICTS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["page_id", *names])

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return narrow.mapInArrow(judged, f"page_id long, {VERDICTS}")
