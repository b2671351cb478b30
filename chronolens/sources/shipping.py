"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkContext:
    """Hand the package to the session's workers once; returns the context."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        # Spark's file server hands it to executors; nothing reads this path there
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-chronolens-"), "chronolens.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for source in root.rglob("*.py"):
                z.write(source, source.relative_to(root.parent))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
    return sc
