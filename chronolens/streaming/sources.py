"""Streams over table folders, and where their results are drained to."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chronolens.sources.staging import new_path

#: Rows of a micro-batch, about so many, where a stream is made from a table in order.
ROWS_A_BATCH = 50_000


def table_stream(spark: SparkSession, sf: str, name: str, files_a_batch: int | None = None) -> DataFrame:
    """The table as a stream of its files; a table of one file is found by its name."""
    path = f"{sf}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    if os.path.isfile(urlparse(path).path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return reader.parquet(path)


def ordered_stream(rows: DataFrame, order: list[str], label: str, rows_a_batch: int = ROWS_A_BATCH) -> DataFrame:
    """``rows`` as a stream whose micro-batches follow each other by ``order``, each about
    ``rows_a_batch`` rows: files of consecutive ranges, read one a batch by their times."""
    spark = rows.sparkSession
    path = new_path(spark, f"{label}-ordered")
    rows.repartitionByRange(max(1, -(-rows.count() // rows_a_batch)), *order).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    newest = max((fs.getFileStatus(f).getModificationTime() for f in files), default=0)
    for i, f in enumerate(files):
        fs.setTimes(f, newest + i, -1)
        if fs.getFileStatus(f).getModificationTime() != newest + i:
            raise RuntimeError(f"{path}: this file system keeps no given file times, so micro-batches would have no order")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run ``stream`` over all that is there, into a table in the shared folder, and read it."""
    spark = stream.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by ``order``, then by the other columns; later values win, nulls lose."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__last")).select(*keys, "__last.*").select(*rows.columns)


class UpdateLog:
    """The updates that a streaming query emits, one folder for each micro-batch.

    ``apply`` is for ``foreachBatch``: a batch that is run again replaces its own
    folder. Readers reduce the updates of a key to the last one (``latest_rows``).
    """

    def __init__(self, updates: DataFrame, label: str):
        self.base, self.schema = new_path(updates.sparkSession, label), updates.schema

    def apply(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.base}/batch={number}")

    def drain(self, updates: DataFrame, mode: str = "append") -> DataFrame:
        """Run ``updates`` over all that is there; its rows with their ``batch``."""
        spark = updates.sparkSession
        state = new_path(spark, "log-state")
        updates.writeStream.outputMode(mode).foreachBatch(self.apply).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        shape = StructType([*self.schema.fields, StructField("batch", LongType())])
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], shape)
        return spark.read.schema(shape).parquet(self.base)
