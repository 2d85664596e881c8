"""Physical plans: what must and must not be in them."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
from lakeline import testviews as V
from lakeline.operators.dashboard import dashboard_tables
from lakeline.operators.rollup import merge_rollups, rollup
from lakeline.operators.sensors import sensor_health
from lakeline.plans.payroll import title_counts
from lakeline.plans.salaries import top_salaries
from lakeline.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not there")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plan(spark):
    return lambda name: plan_of(contract.queries()[name](spark, SF_DIR))


@pytest.mark.parametrize(
    "name", sorted(n for n in QUERIES if not n.startswith(("stream", "live")))
)
def test_no_plan_multiplies_rows_or_leaves_the_jvm(plan, name):
    text = plan(name)
    for bad in ("Cartesian", "NestedLoop", "EvalPython", "MapInPandas", "Scan ExistingRDD"):
        assert bad not in text
    # A window without keys would gather the table in one task.
    for window in re.findall(r"^.*\bWindow \[.*$", text, re.M):
        assert "windowspecdefinition()" not in window and re.search(r"\], \[\w", window)


@pytest.mark.parametrize("name", ["salary_top6", "enrol_top5_courses", "enrol_top5_in_period"])
def test_top_k_is_not_a_sort(plan, name):
    text = plan(name)
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_conditions_reach_the_scan(plan):
    text = plan("enrol_count_in_period")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "EqualTo(o_orderpriority" in pushed and "IsNotNull(o_orderdate)" in pushed
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert read == "o_orderdate:timestamp_ntz,o_orderpriority:string"


def test_metrics_read_only_their_columns(plan):
    read = re.search(r"ReadSchema: struct<(.*?)>", plan("sensor_metrics")).group(1)
    assert read == "event_id:bigint,event_type:string,value:double"


def test_health_groups_by_hash_and_counts_before_the_shuffle(spark):
    readings = V.sensors(V.table(spark, SF_DIR, "events"))
    text = plan_of(sensor_health(readings, ["sensor_id"]))
    assert "partial_avg" in text and "SortAggregate" not in text


def test_rollups_group_by_hash_in_one_shuffle(spark):
    readings = V.instants(V.sensors(V.table(spark, SF_DIR, "events")))
    totals = rollup(readings, ["sensor_id"])
    for df in (totals, merge_rollups(totals.unionByName(totals), ["sensor_id"])):
        assert "SortAggregate" not in plan_of(df) and "partial_sum" in plan_of(df)
    assert plan_of(totals).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("table", ["sensor_metrics", "sensor_health", "sensor_buckets", "sensors_online"])
def test_tables_of_a_batch_group_by_hash(spark, tmp_path, table):
    readings = V.instants(V.sensors(V.table(spark, SF_DIR, "events")))
    rollup(readings, ["sensor_id"]).write.parquet(str(tmp_path / "rollup"))
    totals = merge_rollups(spark.read.parquet(str(tmp_path / "rollup")), ["sensor_id"])
    text = plan_of(dashboard_tables(totals, ["sensor_id"])[table])
    assert "SortAggregate" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_distinct_titles_take_two_shuffles_and_the_final_order(spark):
    text = plan_of(title_counts(V.payroll(V.table(spark, SF_DIR, "orders"))))
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("Exchange rangepartitioning") == 1


def test_salaries_are_parsed_once_for_the_ranking(spark):
    text = plan_of(top_salaries(V.salaries(V.table(spark, SF_DIR, "customer"))))
    filters = "\n".join(re.findall(r"^.*\bFilter .*$", text, re.M))
    assert "regexp_extract" in text and "regexp_extract" not in filters
