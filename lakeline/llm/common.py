"""Reading, staging and removing tables; normalising text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` go on, so no other column can clash; null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and no other letter."""
    # lower() has a fast path for plain ASCII, where it means the same.
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


class Staging:
    """Tables written to the folder all executors share, which cut the lineage.

    ``drop`` removes a table when its readers are done, and ``finish`` stages a result
    and removes all others, so that nothing but the result stays behind.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = scratch_path(spark, label)
        self._count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self._count}"
        self._count += 1
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove staged tables that nothing reads any more; others are left alone."""
        for table in tables:
            for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
                if "/" + self.base.rsplit("/", 1)[-1] + "/" in path:
                    self._remove(path)

    def finish(self, result: DataFrame) -> DataFrame:
        """The result, staged; all tables staged before it are gone."""
        kept = self.keep(result)
        for number in range(self._count - 1):
            self._remove(f"{self.base}/{number}")
        return kept

    def forget(self) -> None:
        """Have the driver collect its garbage: only then do shuffle files of finished plans go."""
        self.spark._jvm.System.gc()

    def _remove(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        target.getFileSystem(conf).delete(target, True)


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a column by which the batches are sorted."""
    parts: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        keys = batch.column(column).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for start, end in zip(edges, edges[1:], strict=False):
            if start == end:
                continue
            if parts and keys[start] != value:
                yield pa.Table.from_batches(parts)
                parts = []
            value = keys[start]
            parts.append(batch.slice(start, end - start))
    if parts:
        yield pa.Table.from_batches(parts)
