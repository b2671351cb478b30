"""Rectangles on screens: texts to regions, regions inside others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolens.sources.shipping import ship


def overlap(a: str, b: str) -> Column:
    """Shared area of the boxes in columns ``{a}_x1`` to ``{a}_y2`` and ``{b}_…``."""
    width = F.least(f"{a}_x2", f"{b}_x2") - F.greatest(f"{a}_x1", f"{b}_x1")
    height = F.least(f"{a}_y2", f"{b}_y2") - F.greatest(f"{a}_y1", f"{b}_y1")
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def assign_regions(texts: DataFrame, regions: DataFrame) -> DataFrame:
    """(image, text_no, region_no): the region that holds a text's centre and shares most area with it.

    ``texts`` has (image, text_no, t_x1, t_y1, t_x2, t_y2), ``regions`` (image,
    region_no, r_x1 …). Ties go to the smaller region; texts in no region are left
    out. The join is an equality on the image, so only boxes of one screen meet.
    """
    x, y = (F.col("t_x1") + F.col("t_x2")) / 2, (F.col("t_y1") + F.col("t_y2")) / 2
    inside = x.between(F.col("r_x1"), F.col("r_x2")) & y.between(F.col("r_y1"), F.col("r_y2"))
    pairs = texts.join(regions, "image").where(inside).withColumn("area", overlap("t", "r")).where("area > 0")
    best = pairs.groupBy("image", "text_no").agg(F.max(F.struct("area", (-F.col("region_no")).alias("minus"))).alias("b"))
    return best.select("image", "text_no", (-F.col("b.minus")).alias("region_no"))


def merged_boxes(boxes: list[tuple], inside: float = 0.5) -> list[tuple]:
    """Boxes, largest first, without those of which more than ``inside`` lies in a larger one
    that stays. Boxes without area lie in none."""
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    kept: list[tuple] = []
    for box in sorted(boxes, key=lambda b: (-area(b), b)):
        shared = [max(0, min(box[2], k[2]) - max(box[0], k[0])) * max(0, min(box[3], k[3]) - max(box[1], k[1])) for k in kept]
        if not area(box) or all(s <= inside * area(box) for s in shared):
            kept.append(box)
    return kept


def merge_regions(regions: DataFrame) -> DataFrame:
    """(image, region_no, x1, y1, x2, y2): an image's boxes without those inside others, in reading order."""
    ship(regions.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = sorted(merged_boxes(list(pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None))), key=lambda b: (b[1], b[0]))
        return pd.DataFrame([(pdf["image"].iloc[0], i, *b) for i, b in enumerate(boxes)], columns=["image", "region_no", "x1", "y1", "x2", "y2"])

    clean = regions.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL").select("image", "x1", "y1", "x2", "y2")
    return clean.groupBy("image").applyInPandas(one, "image string, region_no int, x1 long, y1 long, x2 long, y2 long")


def layout_text(lines: DataFrame, longest: int = 120, most: int = 50) -> DataFrame:
    """(image, text): an image's lines (image, y, x, id, text) in reading order."""
    row = F.struct("y", "x", "id", F.substring(F.trim("text"), 1, longest).alias("t"))
    rows = lines.where(F.trim("text") != "").groupBy("image").agg(F.slice(F.array_sort(F.collect_list(row)), 1, most).alias("r"))
    return rows.select("image", F.array_join(F.transform("r", lambda r: r["t"]), "\n").alias("text"))
