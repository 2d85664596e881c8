"""Periodic runs, repaired conversations and benchmark passages: small and odd cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from llm.brute import cheapest_edits, damaged_rows, leaks, periodic_runs

from lakeline.llm import conversations as turns_module
from lakeline.llm import repeats as repeats_module
from lakeline.llm.conversations import digest_turns, fixed_front, repair_conversations
from lakeline.llm.leaks import FMIndex, Shards, find_leaks, merged, remove_leaks, suffix_order
from lakeline.llm.repeats import find_repeats, runs_of

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "some text"), (None, None), (4, "x" * 200_000)]


# 11: periodic runs


def planted(draw, words):
    """Numbers with a few stretches that repeat."""
    out = [draw.randrange(words) for _ in range(draw.choice([0, 1, 5, 6, 7, 20, 60, 250]))]
    for _ in range(draw.randrange(3)):
        if len(out) > 8:
            start, period = draw.randrange(len(out)), 1 + draw.randrange(len(out) // 3)
            for i in range(start + period, draw.randrange(start, len(out))):
                out[i] = out[i - period]
    return out


@pytest.mark.parametrize("setting", [{}, {"BLOCK": 4}, {"DENSE": 4}, {"SLAB": 16}])
def test_runs_equal_a_search_of_every_period(monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(repeats_module, name, value)
    draw = random.Random(8)
    for _ in range(60):
        texts = [planted(draw, draw.choice([1, 2, 3, 10, 1000])) for _ in range(draw.randrange(1, 5))]
        flat = np.array([w for text in texts for w in text], np.int64)
        assert runs_of(flat, np.cumsum([0, *map(len, texts)])) == [periodic_runs(t) for t in texts]


def test_zeros_are_exact():
    draw = np.random.default_rng(4)
    for scale in (1, 2, 8, 64, 256):
        words = draw.integers(0, 2, 8 * scale + 3)
        found = {tuple(map(int, pair)) for pair in repeats_module._zeros(words, scale)}
        expected = {
            (s, d)
            for s in range(0, len(words) - scale + 1, scale)
            for d in range(scale, 2 * scale)
            if s + d + scale <= len(words) and (words[s : s + scale] == words[s + d : s + d + scale]).all()
        }
        assert expected <= found and len(found - expected) <= 1


def test_runs_of_odd_rows(documents):
    rows = [*ODD, (5, "ha " * 1000), (5, "ha " * 1000), (6, "a b c a b c a b c a b c"), (7, "a b a b a b a")]
    found = find_repeats(documents(*rows)).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found if r.doc_id}
    assert got[1] == got[2] == got[3] == (0, [], "") and got[4][:2] == (1, [])
    assert got[5] == (1000, [(0, 1000, 1)], "ha")
    assert got[6] == (12, [(0, 12, 3)], "a b c")
    assert got[7] == (7, [], "a b a b a b a")
    assert find_repeats(documents()).count() == 0


def test_a_long_text_with_long_periods(documents):
    draw = random.Random(2)
    part = [f"w{draw.randrange(5000)}" for _ in range(30_000)]
    text = " ".join([*part * 4, *part[:500], "end"])
    [row] = find_repeats(documents((1, text))).collect()
    assert [tuple(r) for r in row.runs] == [(0, 120_500, 30_000)]
    assert row.collapsed == " ".join([*part, "end"])


# 12: conversations


def conversation(draw, conv, length, roles=("user", "assistant", "system", "tool", None)):
    texts = ["Yes.", "No?", "cut off", "", " \n", None, "Fine!"]
    return [
        (conv, draw.choice([None, i, i, i]), draw.choice(roles), draw.choice([*texts, f"Text {i}.", f"text {i}"]))
        for i in range(length)
    ]


@pytest.mark.parametrize(("chunk", "passes"), [(256, 8), (3, 8), (2, 1), (1, 0)])
def test_repairs_in_chunks_equal_a_search_of_all_edits(spark, monkeypatch, chunk, passes):
    monkeypatch.setattr(turns_module, "PASSES", passes)
    draw = random.Random(6)
    rows = [r for conv in range(25) for r in conversation(draw, conv, draw.randrange(1, 14))]
    # Roles that settle nothing, and rows that must go: costs never differ by a constant here.
    rows += [(90, i, "system", f"Text {i}.") for i in range(21)]
    rows += [(91, i, "user", "Same.") for i in range(17)] + [(91, 30, "assistant", "End.")]
    rows += [(None, i, "user", f"Nobody {i}.") for i in range(5)]
    schema = "conv_id long, turn long, role string, text string"
    repair = repair_conversations(spark.createDataFrame(rows, schema), chunk=chunk)
    expected = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        expected[conv] = cheapest_edits(own)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    got = {r.conv_id: tuple(r[n] for n in names) for r in repair.audits.collect()}
    # The others hold equal turns, whose order the digests of their texts settle.
    assert {c: got[c] for c in (90, 91, None)} == {c: expected[c][:7] for c in (90, 91, None)}
    for conv, (*_, audit) in got.items():
        own = [r.role[:1] for r in sorted(repair_turns(repair, conv), key=lambda r: (r.place, r.nth))]
        assert len(own) == sum(e != "D" for e in audit)
        roles = "".join(own)
        assert roles == "" or roles.removeprefix("s") in ("ua" * len(roles))[: len(roles) // 2 * 2]


def repair_turns(repair, conv):
    if not hasattr(repair, "_rows"):
        object.__setattr__(repair, "_rows", repair.turns.collect())
    return [r for r in repair._rows if r.conv_id == conv]


def test_costs_are_followed_until_they_differ_by_a_constant():
    draw = random.Random(3)
    front = turns_module._front
    for _ in range(300):
        codes = [draw.randrange(4) + draw.choice([0, 0, 4, 8]) for _ in range(draw.randrange(1, 12))]
        old, new = ([0, 4, 2, 0], [draw.randrange(3) for _ in range(4)])
        old_front = turns_module._level(front(codes, old))
        assert fixed_front(codes, old, old_front, new) == turns_module._level(front(codes, new))


def test_nothing_to_repair(spark):
    schema = "conv_id long, turn long, role string, text string, place string, copy string, next long"
    none = repair_conversations(spark.createDataFrame([], schema))
    assert none.audits.count() == none.turns.count() == digest_turns(none.turns).count() == 0
    good = [(1, 0, "system", "Be kind.", "x", "y", 1), (1, 1, "user", "Hi!", "x", "y", 1)]
    repair = repair_conversations(spark.createDataFrame(good, schema))
    [row] = repair.audits.collect()
    assert (row.audit, row.cost) == ("KKI", 2)
    texts = [(r.role, r.text) for r in repair.turns.orderBy("place", "nth").collect()]
    assert texts == [("system", "Be kind."), ("user", "Hi!"), ("assistant", "")]


def test_damage_of_nulls_is_that_of_blanks():
    rows = [(None, None, None, None), (1, None, None, "Hi.")]
    assert sum(map(len, damaged_rows(rows).values())) <= 4


# 13: benchmark passages


def test_suffixes_and_ranges_of_an_index():
    draw = random.Random(5)
    for _ in range(120):
        n, words = draw.choice([1, 2, 30, 150]), draw.choice([1, 2, 5, 50, 100_000])
        text = np.array([draw.randrange(1, words + 1) for _ in range(n)])
        assert list(suffix_order(text)) == sorted(range(n), key=lambda i: list(text[i:]))
        index = FMIndex(text, words + 1, draw.choice([1, 3, 8]))
        for _ in range(10):
            at, length = draw.randrange(n), draw.randrange(1, 6)
            phrase = list(text[at : at + length])
            row = np.zeros((1, 6), np.int64)
            row[0, 6 - len(phrase) :] = phrase
            _, first, last = index.search(row, np.array([len(phrase)]))
            found = sorted(index.locate(np.arange(first[0], last[0])))
            assert found == [i for i in range(n) if list(text[i : i + len(phrase)]) == phrase]


def test_spans_are_merged():
    spans = np.array([[5, 7], [0, 2], [2, 3], [1, 2], [9, 12], [10, 11]])
    assert merged(spans).tolist() == [[0, 3], [5, 7], [9, 12]]
    assert merged(np.empty((0, 2), np.int64)).shape == (0, 2)


@pytest.mark.parametrize("shards", [Shards(window=4), Shards(window=4, words=7, sample=2, part_bytes=60)])
def test_leaks_of_odd_rows(spark, documents, shards):
    items = [
        (1, "One two, three four five"), (2, "six"), (3, None), (4, "..."), (5, "one TWO three four"),
        (None, "nobody owns this"), (5, "one TWO three four"), (11, "été à la mer"),
    ]
    rows = [
        *ODD, (5, "zero one two three four five six"), (5, "zero one two three four five six"),
        (6, "One-two\tthree (FOUR) " * 3), (7, "six six six"), (8, "one two three"), (9, "ÉTÉ été à la mer"),
        (10, "nobody owns this"), (12, "x y " * 40 + "one two three four five"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(documents(*rows), table, shards).collect()
    assert len(found) == len(rows)
    expected = leaks({i: t for i, t in rows if i}, items, 4)
    for r in found:
        if r.doc_id:
            assert (r.n_words, sum(s.stop - s.start for s in r.spans), r.items) == expected[r.doc_id]
    cut = {r.doc_id: r.text for r in remove_leaks(documents(*rows), table, shards).collect()}
    assert cut[5] == "zero " and cut[7] == "" and cut[8] == "one two three" and cut[1] == ""
    assert find_leaks(documents(), table, shards).count() == 0
    clean = find_leaks(documents((1, "one two")), table.limit(0), shards).collect()
    assert [(r.n_words, r.spans, r.items) for r in clean] == [(2, [], [])]
