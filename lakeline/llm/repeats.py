"""Periodic runs of words: blocks located again by exact convolution, distances extended to runs."""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import texts_of

Batches = Iterator[pa.RecordBatch]
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

#: Words are mapped to numbers modulo this prime, 1 + 3 * 2**18, for number-theoretic transforms of up
#: to 2**18 terms. Products of two centred numbers stay below 2**38, so sums of 2**14 are exact in
#: a double and the transforms are products of small matrices.
PRIME = 786_433
ROOT = 10
#: Rows of one dense transform; longer transforms take two rounds of them.
DENSE = 64
#: Longest block that is transformed whole. Wider scales locate a block of this length, in as many
#: windows as they have distances.
BLOCK = 8192
#: A task transforms at most so many words at a time.
SLAB = 1 << 16
#: Texts of so many bytes are searched together.
TOGETHER = 1 << 22

LEAST_LENGTH = 6
LEAST_REPEATS = 4


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document.

    A run is a stretch of consecutive words with smallest period q, of at least
    ``max(6, 4 * q)`` words, that no neighbouring word extends. ``runs`` lists
    ``start, length, period`` by start and period, counted in words; ``collapsed`` is
    the text with single spaces and each run cut to its first q words.

    At the scale L = 1, 2, 4, … a run of period L to 2L - 1 holds a whole block of the
    grid of L words that comes again within the two blocks after it. The sum of squared
    differences between a block and every place of that window is a correlation, found
    for all blocks at once by transforms modulo a prime, exactly: equal words give 0.
    Each zero is a distance that seeds an extension word by word, which also refutes
    the rare sum that is 0 only modulo the prime.

    Null and empty texts have no words and no runs. Rows without id and repeated rows
    are searched like any other. An empty table gives an empty result.
    """
    return texts_of(docs, id_col, text_col).mapInArrow(_repeats, RUNS)


def _repeats(batches: Batches) -> Batches:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        first, size = 0, 0
        for i in range(batch.num_rows):
            size += len(texts[i].as_buffer()) if texts[i].is_valid else 0
            if size >= TOGETHER or i == batch.num_rows - 1:
                yield _searched(ids.slice(first, i + 1 - first), texts.slice(first, i + 1 - first))
                first, size = i + 1, 0


def _searched(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words = [text.as_buffer().to_pybytes().split() for text in texts]
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    coded = list(map(number.__getitem__, chain.from_iterable(words)))
    edges = np.cumsum([0, *map(len, words)])
    found = runs_of(np.array(coded, np.int64), edges)
    collapsed, starts, lengths, periods, counts = [], [], [], [], []
    for text, runs in zip(words, found, strict=True):
        starts += [s for s, _, _ in runs]
        lengths += [n for _, n, _ in runs]
        periods += [q for _, _, q in runs]
        counts.append(len(runs))
        collapsed.append(b" ".join(collapse(text, runs)))
    entries = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (starts, lengths, periods)], ["start", "length", "period"]
    )
    offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
    columns = [
        ids,
        pa.array([len(text) for text in words], pa.int64()),
        pa.ListArray.from_arrays(offsets, entries),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def runs_of(words: np.ndarray, edges: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each text, by start and period.

    ``words`` are the numbers of the words of all texts one after the other, and text i
    lies between ``edges[i]`` and ``edges[i + 1]``.
    """
    text_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    longest = int(np.diff(edges).max(initial=0))
    runs: list[tuple[int, int, int]] = []  # start, end, period
    scale = 1
    while max(LEAST_LENGTH, LEAST_REPEATS * scale) <= longest:
        # Texts too short for the scale take no part in it.
        long_enough = np.diff(edges) >= max(LEAST_LENGTH, LEAST_REPEATS * scale)
        if long_enough.all():
            chosen, part, owner = None, words, text_of
        else:
            chosen = np.flatnonzero(long_enough[text_of])
            part, owner = words[chosen], text_of[chosen]
        seeds = _zeros(part, scale)
        if len(seeds):
            places = seeds[:, 0] if chosen is None else chosen[seeds[:, 0]]
            inside = seeds[:, 0] + seeds[:, 1] + 1 <= len(part)
            # Block and copy lie in one text, where distances are as in the part.
            last = np.minimum(seeds[:, 0] + seeds[:, 1] + min(scale, BLOCK) - 1, len(part) - 1)
            inside &= owner[seeds[:, 0]] == owner[last]
            seeds = np.column_stack([places, seeds[:, 1]])[inside]
            runs += _extended(words, edges, text_of, seeds, scale, runs)
        scale *= 2
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(edges) - 1)]
    for start, end, period in sorted(runs, key=lambda r: (r[0], r[2])):
        text = text_of[start]
        found[text].append((start - int(edges[text]), end - start, period))
    return found


def _extended(
    words: np.ndarray,
    edges: np.ndarray,
    text_of: np.ndarray,
    seeds: np.ndarray,
    scale: int,
    known: list[tuple[int, int, int]],
) -> list[tuple[int, int, int]]:
    """The runs with a smallest period that is the distance of one of the seeds.

    ``known`` are all runs of smaller scales. A seed whose block and copy lie in a run
    whose period divides its distance repeats that run, and is passed over.
    """
    width = min(scale, BLOCK)
    equal = (words[seeds[:, 0]] == words[seeds[:, 0] + seeds[:, 1]]) & (
        words[seeds[:, 0] + width - 1] == words[seeds[:, 0] + seeds[:, 1] + width - 1]
    )
    seeds = seeds[equal]
    seeds = seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))]
    fresh = np.ones(len(seeds), bool)
    found: list[tuple[int, int, int]] = []

    def pass_over(run: tuple[int, int, int]) -> None:
        start, end, period = run
        low, high = np.searchsorted(seeds[:, 0], (start, end))
        distance = seeds[low:high, 1]
        within = seeds[low:high, 0] + distance + width <= end
        fresh[low:high] &= ~(within & (distance % period == 0))

    for run in known:
        if run[1] - run[0] >= scale + width:
            pass_over(run)
    # Least distances first, so a run is met by its smallest period before a multiple of it.
    order = np.argsort(seeds[:, 1], kind="stable")
    order = order[fresh[order]]
    reached = distance_before = -1
    for k in order.tolist():
        place, distance = int(seeds[k, 0]), int(seeds[k, 1])
        if not fresh[k] or (distance == distance_before and place < reached):
            continue
        text = text_of[place]
        start, end = _stretch(words, place, distance, int(edges[text]), int(edges[text + 1]))
        if end <= place:
            continue  # zero only modulo the prime
        reached, distance_before = end - distance, distance
        if end - start >= max(LEAST_LENGTH, LEAST_REPEATS * distance) and _primitive(
            words[start : start + 2 * distance], distance
        ):
            found.append((start, end, distance))
            pass_over(found[-1])
    return found


def _primitive(twice: np.ndarray, distance: int) -> bool:
    """Whether no smaller period divides the distance, seen on two periods of a longer stretch."""
    rest, factor = distance, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            shift = distance // factor
            if np.array_equal(twice[:-shift], twice[shift:]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _stretch(words: np.ndarray, place: int, distance: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch of period ``distance`` around a place, as start and end."""
    end = place
    step = 4 * distance + 16
    while end + distance < high:
        upto = min(end + step, high - distance)
        differ = words[end:upto] != words[end + distance : upto + distance]
        at = int(differ.argmax()) if differ.any() else -1
        end = end + at if at >= 0 else upto
        if at >= 0:
            break
        step *= 2
    if end == place:
        return place, place
    start, step = place, 4 * distance + 16
    while start > low:
        downto = max(start - step, low)
        differ = words[downto:start] != words[downto + distance : start + distance]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, step = downto, step * 2
    return start, end + distance


# The convolution


def _zeros(words: np.ndarray, scale: int) -> np.ndarray:
    """Pairs (start of a block of the scale's grid, distance) at which the block comes again.

    Distances go from ``scale`` to ``2 * scale - 1``.
    """
    width = min(scale, BLOCK)
    step = scale // width  # rows of ``width`` words in a block of the grid
    values = _residues(words)
    count = len(words) // scale
    # Two rows of filling at the end, so that each window is whole.
    rows = np.zeros(((count + 2) * step + 1, width))
    flat = rows.reshape(-1)
    used = min(len(values), flat.size)
    flat[:used] = values[:used]
    squares = np.concatenate([[0], np.cumsum((flat * flat).astype(np.int64))])
    # Sum of the squares of the ``width`` words from each place on, row by row.
    sums = _centred((squares[width:] - squares[:-width]).astype(np.float64))[:-1]
    sums = sums.reshape(-1, width)
    signs = np.where(np.arange(2 * width) % 2, -1.0, 1.0)
    found = []
    per_slab = max(1, SLAB // scale)
    for first in range(0, count, per_slab):
        last = min(first + per_slab, count) - 1
        spectra = _transform(rows[first * step : (last + 2) * step + 1])
        heads = slice(0, (last - first) * step + 1, step)
        product = np.empty((last - first + 1, 2 * width))
        for shift in range(step):
            near = slice(step + shift, (last - first + 1) * step + shift + 1, step)
            far = slice(near.start + 1, near.stop + 1, step)
            # The window of two rows: the second is moved by half the transform.
            window = _centred(spectra[near] + signs * spectra[far])
            # A mirrored spectrum turns the convolution into a correlation.
            block = spectra[heads]
            np.multiply(block[:, 0], window[:, 0], out=product[:, 0])
            np.multiply(block[:, :0:-1], window[:, 1:], out=product[:, 1:])
            dots = _inverse(_centred(product), width)
            dots *= -2
            dots += sums[first * step : last * step + 1 : step, :1]
            dots += sums[first * step + near.start : first * step + near.stop : step]
            at, offset = np.nonzero(_centred(dots) == 0)
            found.append(np.column_stack([(first + at) * scale, scale + shift * width + offset]))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    # Blocks and copies that reach into the filling are none.
    return pairs[pairs[:, 0] + pairs[:, 1] + width <= len(words)]


def _residues(words: np.ndarray) -> np.ndarray:
    """A centred residue for each word's number, spread so that different words seldom agree."""
    spread = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    spread *= np.uint64(0xBF58476D1CE4E5B9)
    return _centred((spread >> np.uint64(32)).astype(np.float64))


def _centred(x: np.ndarray) -> np.ndarray:
    """The residue of least size; exact for whole numbers below 2**53."""
    times = x * (1 / PRIME)
    np.rint(times, out=times)
    times *= PRIME
    return np.subtract(x, times, out=times)


@functools.cache
def _powers(size: int, inverse: bool) -> np.ndarray:
    """The matrix of a dense transform: entry (j, f) is w**(j * f) for a ``size``-th root of one w."""
    exponents = np.outer(np.arange(size), np.arange(size)) % size
    return _roots(size, inverse)[exponents]


@functools.cache
def _roots(size: int, inverse: bool) -> np.ndarray:
    w = pow(ROOT, (PRIME - 1) // size, PRIME)
    if inverse:
        w = pow(w, -1, PRIME)
    powers = [1]
    for _ in range(size - 1):
        powers.append(powers[-1] * w % PRIME)
    return _centred(np.array(powers, np.float64))


def _ntt(rows: np.ndarray, size: int, inverse: bool, wanted: int) -> np.ndarray:
    """The first ``wanted`` terms of the transform of each row to ``size`` terms; missing ones are 0."""
    if size <= DENSE:
        return _centred(rows @ _powers(size, inverse)[: rows.shape[1], :wanted])
    # Two rounds: term j = a * inner + b, frequency f = g + outer * h.
    inner = 1 << (size.bit_length() // 2)
    outer = size // inner
    count, high = len(rows), -(-wanted // outer)
    table = rows.reshape(count, -1, inner).transpose(0, 2, 1)  # b, a
    table = _ntt(table.reshape(count * inner, -1), outer, inverse, outer)
    table = _centred(table.reshape(count, inner, outer) * _twiddles(size, inner, inverse))
    table = table.transpose(0, 2, 1)  # g, b
    table = _ntt(table.reshape(count * outer, inner), inner, inverse, high)
    return table.reshape(count, outer, high).transpose(0, 2, 1).reshape(count, -1)[:, :wanted]


@functools.cache
def _twiddles(size: int, inner: int, inverse: bool) -> np.ndarray:
    outer = size // inner
    return _roots(size, inverse)[np.outer(np.arange(inner), np.arange(outer)) % size]


def _transform(rows: np.ndarray) -> np.ndarray:
    """The transform of each row of ``width`` terms, filled up to twice as many."""
    return _ntt(rows, 2 * rows.shape[1], False, 2 * rows.shape[1])


def _inverse(spectra: np.ndarray, wanted: int) -> np.ndarray:
    size = spectra.shape[1]
    share = float(_centred(np.array([pow(size, -1, PRIME)], np.float64))[0])
    return _centred(_ntt(spectra, size, True, wanted) * share)
