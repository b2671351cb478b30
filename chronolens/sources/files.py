"""File sources and sinks beside the tables: JSON stores, pictures, reports, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Picture files that count.
PICTURES = ["png", "jpg", "jpeg", "bmp", "webp", "gif"]


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified, id, us): picture files below ``folder``; id and time from names
    such as ``…20250925_155454_090654…``. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(PICTURES))
    stamp = F.regexp_extract("path", r"(\d{8}_\d{6}_\d{6})[^/]*$", 1)
    parts = F.regexp_replace(stamp, r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})_(\d{6})$", "$1-$2-$3 $4:$5:$6.$7+00:00")
    return files.select("path", "length", "modified", F.when(stamp != "", stamp).alias("id"), F.unix_micros(parts.try_cast("timestamp")).alias("us"))


def json_store(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value fields): a store of JSON objects, one file an object from key to record."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "v"))
    return entries.select("key", "v.*")


def reports(spark: SparkSession, pattern: str) -> DataFrame:
    """(day, path, length) of files named by a real date, newest first."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    name = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})\.[^/]+$", 1)
    return files.withColumn("day", name.try_cast("date")).where("day IS NOT NULL").select("day", "path", "length").orderBy(F.desc("day"))


def history(reports_df: DataFrame, budget: int = 14_000) -> DataFrame:
    """Newest reports (day, text) as long as their lengths add up to at most ``budget`` (a bounded list)."""
    used = F.sum(F.length("text")).over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0))
    return reports_df.withColumn("used", used).where(F.col("used") <= budget).drop("used")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(app, window) pairs of an app registry: an object from app to windows, or a plain list of apps."""
    text = spark.read.text(path, wholetext=True)
    named = text.select(F.explode_outer(F.from_json("value", "map<string, array<string>>")).alias("app", "windows")).where("app IS NOT NULL")
    plain = text.where(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", "array<string>")).alias("app"))
    return named.select("app", F.explode_outer(F.array_distinct("windows")).alias("window")).unionByName(plain.select("app", F.lit(None).cast("string").alias("window"))).distinct()


def append_events(events: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines."""
    events.write.mode("append").json(path)


def add_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both with the columns of both; what a side lacks is null (additive schema change)."""
    return old.unionByName(new, allowMissingColumns=True)


def absent_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` does not have, each once (insert or ignore)."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def merged_frames(old: DataFrame, new: DataFrame) -> DataFrame:
    """Frames upserted by frame_id: a chunk path outlives a plain one, null app and window keep the old ones."""
    chunked = lambda c: c.startswith("video_chunk:") | c.startswith("window_chunk:")
    a, b = old.alias("a"), new.dropDuplicates(["frame_id"]).alias("b")
    both = a.join(b, "frame_id", "full")
    keep = chunked(F.col("a.image_path")) & ~F.coalesce(chunked(F.col("b.image_path")), F.lit(False))
    rest = [c for c in old.columns if c not in ("frame_id", "image_path")]
    path = F.when(keep, F.col("a.image_path")).otherwise(F.coalesce("b.image_path", "a.image_path")).alias("image_path")
    return both.select("frame_id", path, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in rest]).select(*old.columns)
