"""Statistics of colours: five-bit histograms, modes, shares off a palette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import blend_u8, colour_key, half_up
from .kernels import nearest as nearest_of
from .pointwise import Colour, nearest, sizes, stride_sample


def colour_histogram(pixels: DataFrame, where=None) -> DataFrame:
    """image_id, key, n and sums of the channels of each five-bit colour of pixels with an alpha of 128 or more."""
    kept = pixels.where(F.col("a") >= 128)
    kept = kept.where(where) if where is not None else kept
    return kept.groupBy("image_id", colour_key().alias("key")).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in "rgb"))


def distinct_colours(pixels: DataFrame, min_ratio: float = 0.0005) -> DataFrame:
    """Number of five-bit colours that have a share of min_ratio; exact."""
    hist = colour_histogram(pixels)
    total = hist.groupBy("image_id").agg(F.sum("n").alias("total"))
    rows = hist.join(total, "image_id").where(F.col("n") >= min_ratio * F.col("total"))
    return rows.groupBy("image_id").agg(F.count("*").alias("colours"))


def _mode(hist: DataFrame) -> DataFrame:
    """The fullest bin of each image, the lowest key of equal ones, with its rounded mean and its share."""
    best = F.max(F.struct("n", (-F.col("key")).alias("minus"), "sr", "sg", "sb")).alias("top")
    top = hist.groupBy("image_id").agg(best, F.sum("n").alias("total"))
    return top.select("image_id", *(half_up(F.col(f"top.s{c}") / F.col("top.n")).alias(c) for c in "rgb"), (F.col("top.n") / F.col("total")).alias("share"))


def border_mode_colour(pixels: DataFrame, min_share: float = 0.8) -> DataFrame:
    """Mean of the commonest five-bit colour on the one-pixel border, if it has the share."""
    s = sizes(pixels)
    ring = pixels.join(s, "image_id").where("x = 0 OR y = 0 OR x = width - 1 OR y = height - 1").select(pixels.columns)
    return _mode(colour_histogram(ring)).where(F.col("share") >= min_share).select("image_id", "r", "g", "b")


def dominant_ink_colour(pixels: DataFrame, back: Colour) -> DataFrame:
    """Mean of the commonest five-bit colour farther than 48 from the background; black if there is none."""
    d2 = sum(((F.col(c) - k) * (F.col(c) - k) for c, k in zip("rgb", back)), F.lit(0))
    found = _mode(colour_histogram(pixels, d2 > 48 * 48))
    rows = pixels.select("image_id").distinct().join(found, "image_id", "left")
    return rows.select("image_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"))


def off_palette_share(pixels: DataFrame, palette: list[Colour], tolerance: float = 24, sample: int = 20000) -> DataFrame:
    """Share of the sampled pixels that no palette colour is within tolerance of, and their mean distance."""
    rows = nearest(palette, stride_sample(pixels, sample))
    return rows.groupBy("image_id").agg(F.avg((F.col("d2") > tolerance * tolerance).cast("double")).alias("off_share"), F.avg(F.sqrt("d2")).alias("error"))


def kmeans_refine(pixels: DataFrame, palette: list[Colour], iterations: int = 10, sample: int = 20000) -> DataFrame:
    """Palette centres of each image after rounds of assignment and plain means; empty centres stay. One row a centre.

    The sample's distinct colours and their counts are combined first; an image's come to one task, `sample` at most,
    where all rounds run, so that rounds cost no shuffle.
    """
    counted = stride_sample(pixels, sample).groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    kind = pixels.schema["image_id"].dataType.simpleString()

    def rounds(key, pdf):
        colours, n = pdf[["r", "g", "b"]].to_numpy(float), pdf["n"].to_numpy(float)
        centres = np.array(palette, float)
        for _ in range(iterations):
            label = nearest_of(colours, centres)
            total = np.bincount(label, n, len(centres))
            sums = np.stack([np.bincount(label, n * colours[:, c], len(centres)) for c in range(3)], 1)
            centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], centres)
        return pd.DataFrame(centres, columns=list("rgb")).assign(image_id=key[0], label=np.arange(len(centres)))[["image_id", "label", "r", "g", "b"]]

    return counted.groupBy("image_id").applyInPandas(rounds, f"image_id {kind}, label int, r double, g double, b double")


def resolve_background(pixels: DataFrame, setting: str | Colour = "auto") -> DataFrame:
    """Background of each image: none (nulls) for transparent, white or a given colour; by itself none if more than a
    twentieth is transparent, else the border's colour, else white."""
    ids = pixels.select("image_id").distinct()
    if setting != "auto":
        fixed = {"transparent": (None,) * 3, "white": (255,) * 3}.get(setting, setting) if isinstance(setting, str) else setting
        return ids.select("image_id", *(F.lit(v).cast("int").alias(c) for v, c in zip(fixed, "rgb")))
    open_ = pixels.groupBy("image_id").agg(F.avg((F.col("a") < 8).cast("double")).alias("open"))
    rows = open_.join(border_mode_colour(pixels), "image_id", "left")
    return rows.select("image_id", *(F.when(F.col("open") <= 0.05, F.coalesce(c, F.lit(255))).alias(c) for c in "rgb"))


def resolve_alpha_mode(pixels: DataFrame, setting: str = "auto") -> DataFrame:
    """mask or composite; by itself mask if more than a twentieth is transparent."""
    open_ = pixels.groupBy("image_id").agg(F.avg((F.col("a") < 8).cast("double")).alias("open"))
    return open_.select("image_id", (F.when(F.col("open") > 0.05, "mask").otherwise("composite") if setting == "auto" else F.lit(setting)).alias("alpha_mode"))


def on_background(pixels: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """Pixels on their image's background; where there is none, on white."""
    back = backgrounds.select("image_id", *(F.coalesce(c, F.lit(255)).alias(f"back_{c}") for c in "rgb"))
    rows = pixels.join(back, "image_id")
    one = lambda c: F.when(F.col("a") == 255, F.col(c)).when(F.col("a") == 0, F.col(f"back_{c}")).otherwise(blend_u8(c, "a", F.col(f"back_{c}"))).cast("int").alias(c)
    return rows.select("image_id", "y", "x", *map(one, "rgb"), F.lit(255).alias("a"))
