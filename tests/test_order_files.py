"""Orders written as CSV by year: no task writes a whole year."""

from __future__ import annotations

import glob
from pathlib import Path

import pytest

from lakeline.registry import _order_files

SF_DIR = "/root/testdata/sf0.001"


def test_each_year_is_written_by_several_tasks(spark):
    if not Path(SF_DIR).is_dir():
        pytest.skip("test tables are not there")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        path = _order_files(spark, SF_DIR)
    finally:
        spark.conf.set(coalesce, before)
    years = glob.glob(path.removesuffix("*") + "year=*")
    assert years and all(len(glob.glob(f"{year}/part-*")) > 1 for year in years)
