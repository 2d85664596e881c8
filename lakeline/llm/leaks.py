"""Benchmark passages in documents: phrases searched backward in an FM-index of each shard."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import Staging, ascii_lower, texts_of

Batches = Iterator[pa.RecordBatch]
HITS = "spans array<struct<start:long,stop:long>>, items array<long>"

#: Every byte that is no letter, digit or part of a longer character.
APART = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
APART = APART[:0x41] + bytes(range(0x61, 0x7B)) + APART[0x5B:]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Shards:
    """How documents and phrases are cut up.

    A shard is the words of some documents, about ``words`` of them; a longer document is
    cut into overlapping parts. Every ``sample``-th suffix position is kept. Phrases go to
    the tasks in parts of about ``part_bytes``.
    """

    window: int = 10
    words: int = 1 << 18
    sample: int = 8
    part_bytes: int = 16 << 20


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    shards: Shards = Shards(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every document.

    The phrases of an item are its windows of ``window`` consecutive words; an item of
    fewer words is one phrase. ``items`` lists, sorted, the items with a phrase in the
    document, and ``spans`` the stretches of words, ``start`` to ``stop`` (not included),
    that occurrences cover, merged where they meet. Words are runs of ASCII letters,
    digits and other characters beyond ASCII, with A-Z lower-cased.

    Each task numbers the words of a shard (words of no phrase share a number), sorts its
    suffixes, and keeps the Burrows-Wheeler transform in a wavelet tree. All phrases
    are searched at once, backward: a step takes the ranks of a word at both ends of a
    phrase's range, and phrases whose range is empty drop out. Occurrences are located
    by steps back to the next sampled suffix position. Shards need nothing of each
    other, so no row is shuffled. Phrases are broadcast in parts of bounded size, each in
    a pass of its own that adds to the spans and items found before.

    Null and empty texts have no words, and items without words no phrase; items
    without id are left out. Repeated items count once. Rows that repeat an id are
    searched like any other. Empty tables give empty results, or documents without hits.
    """
    return _passes(docs, benchmark, shards, id_col, text_col, item_col, item_text_col, "drop").drop("text")


def remove_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    shards: Shards = Shards(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``find_leaks`` with ``text``, from which the spans are cut out.

    What parts the other words stays as it is.
    """
    return _passes(docs, benchmark, shards, id_col, text_col, item_col, item_text_col, "cut")


def _passes(
    docs: DataFrame,
    benchmark: DataFrame,
    shards: Shards,
    id_col: str,
    text_col: str,
    item_col: str,
    item_text_col: str,
    at_last: str,
) -> DataFrame:
    staging = Staging(docs.sparkSession, "leaks")
    phrases = staging.keep(_phrases(benchmark, shards.window, item_col, item_text_col))
    size = phrases.agg(F.sum(F.octet_length("phrase") + 8)).first()[0] or 0
    parts = max(1, -(-int(size) // shards.part_bytes))
    part_of = F.pmod(F.xxhash64("phrase", "item"), F.lit(parts))
    found = texts_of(docs, id_col, text_col).select(
        "doc_id",
        "text",
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start:long,stop:long>>").alias("spans"),
        F.lit(None).cast("array<long>").alias("items"),
    )
    schema = f"doc_id long, text string, n_words long, {HITS}"
    for part in range(parts):
        # One part is at most about ``part_bytes``, or one phrase.
        chosen = phrases.where(part_of == part).toArrow()
        held = docs.sparkSession.sparkContext.broadcast(Phrases.of(chosen))
        then = at_last if part == parts - 1 else "keep"
        found = found.mapInArrow(_search(held, shards, then), schema)
    return found


def _phrases(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct ``phrase, item``: each window of an item's words, joined by blanks."""
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), words.alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(window)), " "))
    return (
        items.where((F.size("words") > 0) & F.col("item").isNotNull())
        .select("item", F.explode(windows).alias("phrase"))
        .distinct()
    )


@dataclass
class Phrases:
    """Distinct phrases as rows of word numbers, aligned at their end, and the items of each.

    Numbers of words start at 2; 0 fills rows up at their front.
    """

    words: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    item_edges: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Phrases:
        words: dict[bytes, int] = {}
        place: dict[bytes, int] = {}
        coded: list[list[int]] = []
        owners: list[list[int]] = []
        for phrase, item in zip(table.column("phrase").to_pylist(), table.column("item").to_pylist(), strict=True):
            key = phrase.encode()
            if key not in place:
                place[key] = len(coded)
                coded.append([words.setdefault(w, len(words) + 2) for w in key.split(b" ")])
                owners.append([])
            owners[place[key]].append(item)
        lengths = np.array([len(c) for c in coded], np.int64)
        rows = np.zeros((len(coded), int(lengths.max(initial=0))), np.int64)
        for row, c in zip(rows, coded, strict=True):
            row[len(row) - len(c) :] = c
        edges = np.cumsum([0, *map(len, owners)])
        items = np.array([i for own in owners for i in own], np.int64)
        return cls(words, rows, lengths, items, edges)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of a text of numbers from 0, sorted; the end is less than any number.

    Ranks by the first words are doubled, and only suffixes that still tie are sorted again.
    """
    n = len(text)
    # As many words as a key has room for, each more than the end, which is 0.
    bits = int(text.max(initial=0) + 1).bit_length()
    length = max(1, 62 // bits)
    keys = np.zeros(n, np.int64)
    for ahead in range(length):
        keys <<= bits
        keys[: max(n - ahead, 0)] |= text[ahead:] + 1
    order = np.argsort(keys)
    rank = np.empty(n, np.int64)
    rank[order] = _first_of_equals(keys[order])
    # Places in the order whose suffixes tie with a neighbour.
    tied = _ties(rank[order], np.arange(n))
    while len(tied) and length < n:
        suffixes = order[tied]
        beyond = np.minimum(suffixes + length, n - 1)
        next_rank = np.where(suffixes + length < n, rank[beyond] + 1, 0)
        own = rank[suffixes]
        keys = own * (n + 1) + next_rank
        moved = np.argsort(keys)
        order[tied] = suffixes = suffixes[moved]
        # Ties fill the same places as before, so a rank is the place of its first one.
        new_rank = tied[_first_of_equals(keys[moved])]
        rank[suffixes] = new_rank
        tied = _ties(new_rank, tied)
        length *= 2
    return order


def _first_of_equals(keys: np.ndarray) -> np.ndarray:
    """For each of the sorted keys the place of the first one that equals it."""
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))


def _ties(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Those places whose rank is also that of a neighbour."""
    same = ranks[1:] == ranks[:-1]
    return places[np.concatenate([[False], same]) | np.concatenate([same, [False]])]


class WaveletTree:
    """Ranks of numbers in a row, by one level of bits for each bit of the numbers.

    Every level is the row sorted, stably, by the bits above it, so it is one array with
    the count of ones in front of each place.
    """

    def __init__(self, values: np.ndarray, largest: int) -> None:
        self.bits = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = values
        for level in reversed(range(self.bits)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(row) - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def ranks(self, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each value lies in front of its place."""
        begin = np.zeros(len(values), np.int64)
        end = places.astype(np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            bit = ((values >> level) & 1).astype(bool)
            before, upto = ones[begin], ones[end]
            begin = np.where(bit, zeros + before, begin - before)
            end = np.where(bit, zeros + upto, end - upto)
        return end - begin

    def step(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each place, and how often it lies in front of it."""
        value = np.zeros(len(places), np.int64)
        begin = np.zeros(len(places), np.int64)
        end = places.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[end + 1] > ones[end]
            before, upto = ones[begin], ones[end]
            value = value * 2 + bit
            begin = np.where(bit, zeros + before, begin - before)
            end = np.where(bit, zeros + upto, end - upto)
        return value, end - begin


class FMIndex:
    """Backward search and location in a text of numbers from 1 on."""

    def __init__(self, text: np.ndarray, largest: int, sample: int) -> None:
        # The end is a suffix of its own, the least one, whose number is 0.
        text = np.append(text, 0)
        order = suffix_order(text)
        self.tree = WaveletTree(text[order - 1], largest)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 2))])
        kept = order % sample == 0
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.samples = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """``phrase, first, last``: the range of suffixes that begin with each phrase that occurs."""
        alive = np.arange(len(phrases))
        first = np.zeros(len(phrases), np.int64)
        last = np.full(len(phrases), self.less[-1], np.int64)
        for back in range(1, phrases.shape[1] + 1):
            going = lengths[alive] >= back
            who = alive[going]
            if not len(who):
                break
            word = phrases[who, -back]
            # Phrases with the same ending ask for the same ranks.
            first[who] = self.less[word] + self.tree.ranks(word, first[who])
            last[who] = self.less[word] + self.tree.ranks(word, last[who])
            alive = alive[first[alive] < last[alive]]
        return alive, first[alive], last[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows begin."""
        found = np.empty(len(rows), np.int64)
        waiting, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(waiting):
            known = self.kept[at]
            found[waiting[known]] = self.samples[self.kept_before[at[known]]] + steps
            waiting, at = waiting[~known], at[~known]
            value, rank = self.tree.step(at)
            at = self.less[value] + rank
            steps += 1
        return found


def _search(held, shards: Shards, then: str) -> Callable[[Batches], Batches]:
    def search(batches: Batches) -> Batches:
        phrases: Phrases = held.value
        other = len(phrases.words) + 2  # any word of no phrase
        number = phrases.words.get
        overlap = max(int(phrases.lengths.max(initial=1)) - 1, 0)
        for batch in batches:
            documents: list[list[np.ndarray]] = []
            sizes: list[int] = []
            waiting: list[tuple[int, int, np.ndarray]] = []  # document, start, words
            results = _Results(batch.num_rows)
            held_words = 0
            for doc in range(batch.num_rows):
                raw = batch.column(1)[doc].as_buffer().to_pybytes()
                words = np.array([number(w, other) for w in raw.translate(APART).split()], np.int64)
                sizes.append(len(words))
                for start in range(0, max(len(words) - overlap, 1), shards.words):
                    part = words[start : start + shards.words + overlap]
                    waiting.append((doc, start, part))
                    held_words += len(part)
                    if held_words >= shards.words:
                        _search_shard(phrases, waiting, other, shards.sample, results)
                        waiting, held_words = [], 0
            if waiting:
                _search_shard(phrases, waiting, other, shards.sample, results)
            yield _with_hits(batch, sizes, results, then)

    return search


class _Results:
    def __init__(self, count: int) -> None:
        self.spans: list[list[np.ndarray]] = [[] for _ in range(count)]
        self.items: list[list[np.ndarray]] = [[] for _ in range(count)]


def _search_shard(
    phrases: Phrases,
    parts: list[tuple[int, int, np.ndarray]],
    other: int,
    sample: int,
    results: _Results,
) -> None:
    if not len(phrases.rows):
        return
    # The number 1 parts the documents, and is in no phrase.
    text = np.concatenate([x for _, _, words in parts for x in (words, [1])]).astype(np.int64)
    edges = np.cumsum([0, *(len(words) + 1 for _, _, words in parts)])
    index = FMIndex(text, other, sample)
    phrase, first, last = index.search(phrases.rows, phrases.lengths)
    counts = last - first
    rows = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    places = index.locate(rows)
    phrase = np.repeat(phrase, counts)
    if not len(places):
        return
    part = np.searchsorted(edges, places, "right") - 1
    order = np.argsort(part, kind="stable")
    part, places, phrase = part[order], places[order], phrase[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for at, here, these in zip(
        part[np.concatenate([[0], cuts])], np.split(places, cuts), np.split(phrase, cuts), strict=True
    ):
        doc, start, _ = parts[at]
        begin = here - edges[at] + start
        results.spans[doc].append(np.column_stack([begin, begin + phrases.lengths[these]]))
        distinct = np.unique(these)
        results.items[doc] += [phrases.items[phrases.item_edges[p] : phrases.item_edges[p + 1]] for p in distinct]


def merged(spans: np.ndarray) -> np.ndarray:
    """The union of spans, as spans that neither meet nor overlap."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.column_stack([spans[new, 0], reach[ends]])


def _with_hits(batch: pa.RecordBatch, sizes: list[int], results: _Results, then: str) -> pa.RecordBatch:
    """The documents with hits of this pass and of those before, and ``then`` with texts or not."""
    spans, items = [], []
    before_spans, before_items = batch.column("spans"), batch.column("items")
    for doc in range(batch.num_rows):
        old = before_spans[doc].as_py() or []
        parts = [np.array([(s["start"], s["stop"]) for s in old], np.int64).reshape(-1, 2)]
        spans.append(merged(np.concatenate(parts + results.spans[doc])))
        known = np.array(before_items[doc].as_py() or [], np.int64)
        items.append(np.unique(np.concatenate([known, *results.items[doc]])))
    flat = np.concatenate([np.empty((0, 2), np.int64), *spans])
    entries = pa.StructArray.from_arrays(
        [pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], ["start", "stop"]
    )
    span_edges = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
    item_edges = pa.array(np.cumsum([0, *map(len, items)]), pa.int32())
    all_items = np.concatenate([np.empty(0, np.int64), *items])
    text = batch.column("text")
    if then == "drop":
        text = pa.nulls(batch.num_rows, pa.string())
    elif then == "cut":
        text = pa.array([without_spans(t.as_py(), s) for t, s in zip(text, spans, strict=True)], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            text,
            pa.array(sizes, pa.int64()),
            pa.ListArray.from_arrays(span_edges, entries),
            pa.ListArray.from_arrays(item_edges, pa.array(all_items, pa.int64())),
        ],
        ["doc_id", "text", "n_words", "spans", "items"],
    )


def without_spans(text: str, spans: np.ndarray) -> str:
    """A text without the words of the spans, with what parts its other words."""
    if not len(spans):
        return text
    raw = text.encode()
    plain = raw.translate(APART)
    places, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    kept, end = [], 0
    for start, stop in spans:
        kept.append(raw[end : places[start][0]])
        end = places[stop - 1][1]
    return b"".join([*kept, raw[end:]]).decode()
