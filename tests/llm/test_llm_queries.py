"""The registered queries over whole tables, against SQL or brute force."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from llm.brute import (
    WORD,
    base_spans,
    cheapest_edits,
    damaged_rows,
    leaks,
    near_components,
    periodic_runs,
    repeated_places,
)
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lakeline.llm.common import read_table
from lakeline.llm.queries import ORACLE, QUERIES
from lakeline.llm.toxicity import held_out, learn


def cell(value):
    return "" if value is None else str(value)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_the_entry_registers_all_of_them():
    import __spark_entry__ as contract

    assert set(contract.queries()) >= {*QUERIES, "pipeline"}
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    found = QUERIES[name](spark, sf_dir)
    expected = tables.execute(ORACLE[name])
    columns = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(columns)
    got = sorted(tuple(map(cell, row)) for row in found.select(*columns).collect())
    assert got == sorted(tuple(map(cell, row)) for row in expected.fetchall())


def test_shared_passages_cover_every_long_repeat(spark, sf_dir, texts):
    places = repeated_places(texts, 50)
    spans = {}
    for row in QUERIES["op3_shared_passages"](spark, sf_dir).collect():
        assert row.source_id != row.doc_id and row.similarity >= 0.8
        spans.setdefault(row.doc_id, []).append((row.start, row.stop))
    assert places
    for run, found in places.items():
        if len(set(run)) > 5:  # a run of one word is marked as far as its source goes
            left = [
                i
                for i, js in found.items()
                if not all(any(a <= j and j + 50 <= b for a, b in spans.get(i, ())) for j in js)
            ]
            assert len(left) <= 1, " ".join(run)


def test_licence_lines_are_found_and_named(spark, sf_dir, texts):
    fixed = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    }
    expected = {
        (i, k, fixed[line])
        for i, text in texts.items()
        for k, line in enumerate(text.split("\n"))
        if line in fixed
    }
    found = QUERIES["op5_licence_scan"](spark, sf_dir).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in found} >= expected
    assert {r.doc_id for r in found} == {i for i, *_ in expected}


def test_ids_and_texts_are_those_of_the_tokenizers_library(spark, sf_dir, texts, tokenizer):
    expected = set()
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        digits = ",".join(map(str, ids))
        sums = [hashlib.sha256(s.encode()).hexdigest() for s in (digits, decoded)]
        expected.add((i, len(ids), *sums))
    found = QUERIES["op6_bpe_roundtrip"](spark, sf_dir).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_pieces_are_packed_without_gaps(spark, sf_dir, texts, tokenizer):
    expected, total = {}, 0
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            expected[i, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    sequences = {}
    rows = QUERIES["op7_best_fit_packing"](spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    least = -(-total // 2048)
    assert len(sequences) == least
    assert max(r.generations for r in rows) > 0


def test_base_spans_are_those_of_the_patterns(spark, sf_dir, texts):
    for row in QUERIES["op8_personal_data"](spark, sf_dir).collect():
        base = base_spans(texts[row.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        counts = [sum(k == kind for k, *_ in base) for kind in ("email", "ip", "card", "phone")]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert set(listed) <= set(row.spans.split(","))


def test_scores_look_at_no_held_out_label(spark, sf_dir, texts):
    rows = QUERIES["op9_toxicity"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_other_held_out_labels_teach_the_same(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    turned = F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    kind = labels.schema["toxic"].dataType
    flipped = labels.withColumn("toxic", turned.cast(kind))
    assert flipped.exceptAll(labels).count() > 0
    assert learn(docs, flipped) == learn(docs, labels)


def test_near_copies_equal_all_pairs(spark, sf_dir, texts):
    expected = near_components(texts, 3, 85)
    found = QUERIES["op10_minhash_near_dedup"](spark, sf_dir).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert got == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_stages_of_the_pipeline(spark, sf_dir, texts, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = docs.schema
    kept = [dict(texts)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in schema]
            rows = docs.collect()
            assert all(r.n_chars == len(r.text) for r in rows) or i < 3
            kept.append({r.doc_id: r.text for r in rows})
    toxic, exact, near, masked = kept[1:]
    assert set(toxic) <= set(texts) and len(toxic) > 0.5 * len(texts)
    groups = {}
    for i, t in toxic.items():
        groups.setdefault(bytes(t, "utf-8").lower(), []).append(i)
    assert set(exact) == {max(ids) for ids in groups.values()}
    components = near_components(exact, 5, 80)
    assert set(near) == {i for i, (_, first) in components.items() if first == i}
    assert set(masked) == set(near)
    assert not any(base_spans(t) for t in masked.values())
    assert {r.doc_id for r in docs.select("doc_id").collect()} == set(masked)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_periodic_runs_equal_a_search_of_every_period(spark, sf_dir, texts):
    found = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert set(found) == set(texts)
    looped = 0
    for i, text in texts.items():
        own, h = WORD.findall(text), zlib.crc32(str(i).encode())
        n, g = len(own), h // 10
        if h % 10 == 0 and n:
            looped += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[j] if j < a else own[a + (j - a) % p] for j in range(n)]
        if n > 2500:  # too long for a search of every period
            continue
        runs = periodic_runs(own)
        dropped = {j for start, length, q in runs for j in range(start + q, start + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        row = found[i]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert row.collapsed_sha256 == sha(" ".join(w for j, w in enumerate(own) if j not in dropped))
    assert looped > 5


def test_repairs_equal_a_search_of_all_edits(spark, sf_dir, tables):
    rows = tables.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    expected = {}
    for conv, left in damaged_rows(rows).items():
        *numbers, text = cheapest_edits(left)
        expected[conv] = (*numbers, sha(text))
    found = QUERIES["op12_conversation_repair"](spark, sf_dir).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == expected and len(found) == len(expected)


def test_leaks_equal_a_search_of_every_window(spark, sf_dir, texts, tables):
    items = tables.execute("SELECT item_id, text FROM benchmark").fetchall()
    expected = {
        i: (n, hit, len(held), sha(",".join(sorted(map(str, held)))), hit > 0)
        for i, (n, hit, held) in leaks(texts, items, 10).items()
    }
    found = QUERIES["op13_benchmark_leaks"](spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == expected and len(found) == len(expected)
    assert any(hit for _, hit, *_ in expected.values())
