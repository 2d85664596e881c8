"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "lakeline",
    master: str | None = None,
    time_zone: str = "UTC",
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution and a disk-backed streaming state store.

    The caller chooses the time zone, and adds cluster settings (partition
    counts, memory, connector packages) through ``settings``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", time_zone)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_scratch() -> str:
    return tempfile.mkdtemp(prefix="lakeline-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder all executors share (``spark.checkpoint.dir``).

    A machine-local folder stands in only on a local master that names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_scratch()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
