"""Streaming jobs; each returns a running StreamingQuery."""

from lakeline.streaming.current import current_store, read_current, start_current_table
from lakeline.streaming.dashboard import DashboardStore, start_dashboard
from lakeline.streaming.jobs import (
    latest_state,
    run_to_end,
    start_json_sink,
    start_keyed_state,
    start_running_metrics,
    windowed_means,
)
from lakeline.streaming.late import open_buckets, start_closed_buckets
from lakeline.streaming.runs import RunStore

__all__ = [
    "DashboardStore",
    "RunStore",
    "current_store",
    "latest_state",
    "open_buckets",
    "read_current",
    "run_to_end",
    "start_closed_buckets",
    "start_current_table",
    "start_dashboard",
    "start_json_sink",
    "start_keyed_state",
    "start_running_metrics",
    "windowed_means",
]
