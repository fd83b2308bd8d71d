"""Similarity of two rasters of equal size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pointwise import PIXEL, sizes

C1, C2 = 6.5025, 58.5225


def paired(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Pixels of both, those of b with a 2 to their names."""
    return a.select(*PIXEL, *columns).join(b.select(*PIXEL, *(F.col(c).alias(f"{c}2") for c in columns)), PIXEL)


def same_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Images of different size or in one of the two only; metrics are defined if there are none."""
    sides = lambda d: sizes(d).select("image_id", "width", "height")
    return sides(a).exceptAll(sides(b)).unionByName(sides(b).exceptAll(sides(a)))


def mean_absolute_error(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("image_id").agg(F.avg(F.abs(F.col("v") - F.col("v2")).cast("double")).alias("mae"))


def share_different(pairs: DataFrame, threshold: float) -> DataFrame:
    m = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"))
    return pairs.groupBy("image_id").agg(F.avg((m > threshold).cast("double")).alias("different"))


def iou(pairs: DataFrame) -> DataFrame:
    """Ink that both have over ink that one has; 1 if none has any."""
    s = pairs.groupBy("image_id").agg(F.sum(F.col("m") * F.col("m2")).alias("both"), F.sum(F.greatest("m", "m2")).alias("any"))
    return s.select("image_id", F.when(F.col("any") > 0, F.col("both") / F.col("any")).otherwise(1.0).alias("iou"))


def ssim_windows(pairs: DataFrame, size: int = 8, stride: int = 4) -> DataFrame:
    """Structural similarity of each full window: every pixel adds to the four windows at most that it lies in."""
    s = sizes(pairs).select("image_id", "width", "height")
    rows = pairs.join(s, "image_id")

    def starts(c: str, side: str) -> Column:
        """Numbers of the windows along one side that hold a place; a shorter side has one window of its own length."""
        last = F.floor(F.greatest(F.lit(0), F.col(side) - size) / stride)
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - (size - 1)) / stride))
        return F.explode(F.when(first <= F.least(last, F.floor(F.col(c) / stride)), F.sequence(first, F.least(last, F.floor(F.col(c) / stride)))).otherwise(F.array().cast("array<bigint>")))

    rows = rows.withColumn("wy", starts("y", "height")).withColumn("wx", starts("x", "width"))
    a, b = F.col("v").cast("double"), F.col("v2").cast("double")
    w = rows.groupBy("image_id", "wy", "wx").agg(F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"))
    n = F.col("n")
    ma, mb = F.col("sa") / n, F.col("sb") / n
    va, vb, cov = F.greatest(F.lit(0.0), F.col("saa") / n - ma * ma), F.greatest(F.lit(0.0), F.col("sbb") / n - mb * mb), F.col("sab") / n - ma * mb
    return w.select("image_id", "wy", "wx", ((2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))).alias("ssim"))


def ssim(pairs: DataFrame) -> DataFrame:
    return ssim_windows(pairs).groupBy("image_id").agg(F.avg("ssim").alias("ssim"), F.count("*").alias("windows"))


def fidelity(similarity: Column, overlap: Column) -> Column:
    return 0.6 * similarity + 0.4 * overlap


def tuner_score(fidelity_: Column, corner_share: Column, nodes: Column, perimeter: Column) -> Column:
    density = F.least(F.lit(1.0), nodes / F.when(perimeter > 0, 2 * perimeter))
    return fidelity_ - 0.15 * corner_share - 0.10 * F.coalesce(density, F.lit(1.0))
