"""Sinks: lake files, text results, tables, collections and metric stores."""

from lakeline.sinks.days import DayStore, read_days, write_days
from lakeline.sinks.files import write_lake_csv, write_lake_json, write_tsv
from lakeline.sinks.stores import (
    migrate,
    read_version,
    save,
    write_batch,
    write_docs,
    write_metrics,
    write_table,
    write_version,
)

__all__ = [
    "DayStore",
    "migrate",
    "read_days",
    "read_version",
    "save",
    "write_batch",
    "write_days",
    "write_docs",
    "write_lake_csv",
    "write_lake_json",
    "write_metrics",
    "write_table",
    "write_tsv",
    "write_version",
]
