"""Trailing moving average over bucket means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smooth(
    buckets: DataFrame,
    keys: Sequence[str],
    size: int = 5,
    bucket: str = "bucket",
    value: str = "average_valid",
    name: str = "smoothed",
    segment: str = "month",
) -> DataFrame:
    """Mean of each bucket and the ``size - 1`` buckets with data before it, per key.

    One key may hold most of the buckets, so its history is cut into calendar
    segments (``segment``: a ``date_trunc`` unit) that are averaged in parallel.
    That settles every bucket but the first few of a segment, which look back
    across its start. They see the same neighbours among the first and last few
    buckets of all segments, and those are few enough for one window per key.
    The result equals one window over the whole of each key.
    """
    reach = size - 1
    with_data = buckets.where(F.col(value).isNotNull()).withColumn(
        "_segment", F.date_trunc(segment, bucket)
    )
    inside = Window.partitionBy(*keys, "_segment").orderBy(bucket)
    averaged = with_data.withColumns(
        {
            name: F.avg(value).over(inside.rowsBetween(-reach, 0)),
            "_position": F.row_number().over(inside),
            "_later": F.lead(bucket, reach).over(inside),
        }
    )
    first = F.col("_position") <= reach
    last = F.col("_later").isNull()
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(-reach, 0)
    edges = averaged.where(first | last).withColumn(name, F.avg(value).over(across))
    result = averaged.where(~first).unionByName(edges.where(first))
    return result.drop("_segment", "_position", "_later")
