"""Proof that a copy is complete, and copies that go on."""

from __future__ import annotations

import pytest
from helpers import rows
from pyspark.sql import functions as F

from lakeline.config import DocTarget, TableTarget
from lakeline.plans.verification import copy_in_parts, differences, read_parts
from lakeline.sinks.files import remove
from lakeline.sinks.stores import save

SCHEMA = "id long, name string, measurement double, seen timestamp"


@pytest.fixture
def table(spark):
    moment = F.timestamp_seconds(F.col("id") + F.lit(1_700_000_000))
    return lambda n: spark.range(n).select(
        "id",
        F.concat(F.lit("s"), F.col("id") % 7).alias("name"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 3).alias("measurement"),
        moment.alias("seen"),
    )


def found(source, target, key="id", **options):
    return rows(differences(source, target, key, **options))


def test_a_complete_copy_shows_no_difference(table):
    assert found(table(5000), table(5000).repartition(3), leaf=10) == []
    assert found(table(0), table(0)) == []
    assert found(table(3).withColumn("measurement", F.lit(-0.0)), table(3).withColumn("measurement", F.lit(0.0))) == []


@pytest.mark.parametrize("leaf", [1, 50, 100_000])
def test_every_difference_is_found(table, leaf):
    source = table(3000)
    target = (
        source.where("id NOT IN (5, 2999)")
        .withColumn("name", F.when(F.col("id") == 77, "other").otherwise(F.col("name")))
        .withColumn("measurement", F.when(F.col("id") != 1201, F.col("measurement")))
        .unionByName(source.where("id IN (9, 1500)"))
        .unionByName(source.limit(1).withColumn("id", F.lit(10_000).cast("long")))
        .unionByName(source.limit(1).withColumn("id", F.lit(None).cast("long")))
    )
    expected = [
        (None, "extra", 0, 1), (10_000, "extra", 0, 1), (1201, "changed", 1, 1), (1500, "doubled", 1, 2),
        (2999, "lost", 1, 0), (5, "lost", 1, 0), (77, "changed", 1, 1), (9, "doubled", 1, 2),
    ]
    assert found(source, target, fanout=8, leaf=leaf) == expected
    turned = {(k, a, b) for k, _, b, a in expected}
    assert {(k, a, b) for k, _, a, b in found(target, source, fanout=8, leaf=leaf)} == turned


def test_swapped_values_and_rows_of_one_key(table):
    source = table(100).withColumn("id", F.lit(4).cast("long"))
    assert found(source, source.limit(99)) == [(4, "missing", 100, 99)]
    swapped = table(2).withColumn("name", F.when(F.col("id") == 0, "s1").otherwise("s0"))
    assert found(table(2), swapped) == [(0, "changed", 1, 1), (1, "changed", 1, 1)]


def test_keys_that_are_texts_or_very_large(table):
    source = table(500).withColumn("id", F.concat(F.lit("k"), "id"))
    assert found(source, source.where("id <> 'k7'"), fanout=4, leaf=3) == [("k7", "lost", 1, 0)]
    far = table(2).withColumn("id", F.expr("id * 4611686018427387904 - 4611686018427387904"))
    assert found(far, far.where("id = 0"), leaf=1)[0][1:] == ("lost", 1, 0)


def test_only_ranges_that_differ_are_read_again(spark, table, folder):
    table(40_000).repartitionByRange(20, "id").write.parquet(folder("source"))
    source = spark.read.parquet(folder("source"))
    result = differences(source, source.where("id <> 33333"), "id", fanout=10, leaf=50)
    assert rows(result) == [(33_333, "lost", 1, 0)]
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,333" in plan and "LessThan(id,333" in plan


@pytest.mark.parametrize("broken", [0, 2, 5])
def test_a_broken_copy_goes_on_without_doubles(spark, table, folder, broken):
    source, target = TableTarget.parquet_files(folder("source")), TableTarget.parquet_files(folder("target"))
    with_null = table(100).unionByName(table(3).withColumn("id", F.lit(None).cast("long")))
    save(with_null, source)
    copy = (spark, source, target, "id", folder("manifest"))
    assert copy_in_parts(*copy, parts=5, at_most=broken) == broken
    save(with_null.limit(7), target.named(f"part={broken}"))  # half a range
    remove(spark, folder("target", f"part={broken}", "_SUCCESS"))
    assert copy_in_parts(*copy, parts=5) == 6 - broken
    assert copy_in_parts(*copy, parts=5) == 0
    assert rows(read_parts(spark, target)) == rows(with_null)
    assert rows(differences(with_null, read_parts(spark, target), "id")) == []


def test_a_copy_of_nothing_and_into_documents(spark, table, folder):
    source = TableTarget.parquet_files(folder("source"))
    documents = DocTarget.json_files(folder("docs"), table(1).schema)
    save(table(0), source)
    assert copy_in_parts(spark, source, documents, "id", folder("manifest")) == 1
    save(table(20), source)
    documents = DocTarget.json_files(folder("more"), table(1).schema)
    assert copy_in_parts(spark, source, documents, "id", folder("other"), parts=3) == 4
    assert found(table(20), read_parts(spark, documents)) == []
