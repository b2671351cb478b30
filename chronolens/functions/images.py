"""Differences between pictures, from pixel arrays, as plain functions and Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def histogram(pixels: np.ndarray, bins: int = 64) -> np.ndarray:
    """Share of grey values (0..255) in each of ``bins`` equal bins."""
    counts = np.histogram(pixels, bins=bins, range=(0, 256))[0].astype(float)
    return counts / max(counts.sum(), 1)


def hellinger(a: np.ndarray, b: np.ndarray) -> float:
    """Hellinger distance of two normalised histograms, 0 to 1."""
    return float(np.sqrt(max(0.0, 1 - np.sqrt(a * b).sum())))


def structure(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity from means, variances and covariance of whole pictures."""
    a, b = a.astype(float), b.astype(float)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    cov = ((a - a.mean()) * (b - b.mean())).mean()
    return float((2 * a.mean() * b.mean() + c1) * (2 * cov + c2) / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (a.var() + b.var() + c2)))


def change(a: np.ndarray, b: np.ndarray) -> float:
    """How much a picture changed: 0 if equal, else the mean of both measures."""
    if a.shape == b.shape and (a == b).all():
        return 0.0
    return (hellinger(histogram(a), histogram(b)) + 1 - max(-1.0, min(1.0, structure(a, b)))) / 2


def rms(a: np.ndarray, b: np.ndarray) -> float:
    """Root mean square difference as a share of 255, in wide arithmetic."""
    return float(np.sqrt(((a.astype(float) - b.astype(float)) ** 2).mean()) / 255)


def is_plain(pixels: np.ndarray, below: float = 5.0) -> bool:
    """Whether a picture is of one colour: its grey values hardly vary."""
    return bool(np.std(pixels) < below)


def change_udf(a: Column, b: Column) -> Column:
    """``change`` of two array<int> columns; null where either is null or sizes differ."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None or len(p) != len(q) or not len(p) else change(np.asarray(p), np.asarray(q)) for p, q in zip(x, y)], dtype="float64")

    return score(a, b)


def picture_hash(pixels: Column) -> Column:
    """60 bits of a picture's bytes, as a long."""
    return F.conv(F.substring(F.md5(pixels), 1, 15), 16, 10).cast("long")


def histogram_distance(a: Column, b: Column, kind: str = "hellinger") -> Column:
    """Distance of two histogram columns by Spark's own functions: hellinger, chi_square or correlation."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    if kind == "hellinger":
        return F.sqrt(F.greatest(F.lit(0.0), 1 - total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))))
    if kind == "chi_square":
        return total(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0))) / 2
    if kind != "correlation":
        raise ValueError(f"no such distance: {kind}")
    mean = lambda c: total(c) / F.size(c)
    cov = total(F.zip_with(a, b, lambda x, y: (x - mean(a)) * (y - mean(b))))
    var = lambda c: total(F.transform(c, lambda x: (x - mean(c)) * (x - mean(c))))
    return 1 - cov / F.when(var(a) * var(b) > 0, F.sqrt(var(a) * var(b)))
