"""Runs of equal values along time, built in time chunks and joined at their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def islands(df: DataFrame, keys: list[str], value: str, tie: str, chunk_us: int = DAY_US, across: bool = True) -> DataFrame:
    """Maximal runs of equal ``value`` among rows (keys, us, tie, value) ordered by us, tie.

    Gives (keys, value, chunk, start_us, end_us, n, next_us): next_us is the start of the
    key's next run, null for its last. Runs are found inside each (key, chunk); only a
    chunk's first and last run meet their neighbours, so no task holds a key's whole
    history. With ``across`` false a run ends with its chunk. Null values equal each
    other; rows without ``us`` are left out; an empty table gives no rows.
    """
    rows = df.where(F.col("us").isNotNull()).select(*keys, "us", tie, value, F.floor(F.col("us") / F.lit(chunk_us)).alias("chunk"))
    inside = Window.partitionBy(*keys, "chunk").orderBy("us", tie)
    fresh = F.when(F.row_number().over(inside) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(inside))).cast("int"))
    local = (
        rows.withColumn("__fresh", fresh)
        .withColumn("__no", F.sum("__fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "chunk", "__no")
        .agg(F.first(value).alias(value), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(*keys, "chunk").orderBy("__no")
    local = local.withColumn("next_us", F.lead("start_us").over(order))
    shape = [*keys, value, "chunk", "start_us", "end_us", "n", "next_us"]
    if not across:
        return local.select(*shape)
    edge = (F.col("__no") == 1) | F.col("next_us").isNull()
    along = Window.partitionBy(*keys).orderBy("chunk", "__no")
    joined = (F.col("__no") == 1) & F.lag(F.lit(1)).over(along).isNotNull() & F.col(value).eqNullSafe(F.lag(value).over(along))
    edges = (
        local.where(edge)
        .withColumn("__new", (~joined).cast("int"))
        .withColumn("next_us", F.coalesce("next_us", F.lead("start_us").over(along)))
        .withColumn("__run", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    )
    merged = edges.groupBy(*keys, "__run").agg(
        F.first(value).alias(value), F.min("chunk").alias("chunk"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"), F.max_by("next_us", F.struct("chunk", "__no")).alias("next_us")
    )
    return local.where(~edge).select(*shape).unionByName(merged.select(*shape))
