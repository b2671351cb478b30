"""Lineage cuts that survive the loss of an executor.

Everything is written under ``spark.checkpoint.dir``, the folder that all
executors share. Only where the session names none and all runs in one process
(tests, a laptop) is a temporary folder made; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode a temporary one where the session names none."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-chronolens-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/chronolens/{label}-{os.getpid()}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written completely (and is still there)."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Write DataFrames of one schema one after another as one staged table and read it back;
    the shuffle files of each go as soon as it is written, not when the driver collects garbage."""
    path, paths = None, []
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or new_path(spark, label)
        paths.append(f"{path}/{len(paths)}")
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            part.write.parquet(paths[-1])
        finally:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(*paths)


def drop(staged: DataFrame) -> None:
    """Delete the table that ``stage`` wrote for ``staged``, once nothing reads it any more."""
    files = staged.inputFiles()
    if files:
        path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
