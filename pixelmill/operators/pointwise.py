"""Projections, filters and predicates on pixels (image_id, y, x, r, g, b, a) and levels (image_id, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import blend_u8, luma, premultiplied, unpremultiplied, weighted_distance2

PIXEL = ["image_id", "y", "x"]
Colour = tuple[int, int, int]


def to_gray(pixels: DataFrame) -> DataFrame:
    return pixels.select(*PIXEL, luma().alias("v"))


def alpha_to_gray(pixels: DataFrame) -> DataFrame:
    return pixels.select(*PIXEL, F.col("a").cast("float").alias("v"))


def composite_on_colour(pixels: DataFrame, back: Colour) -> DataFrame:
    """Opaque pixels stay, transparent ones become the background, others are blended; the result is opaque."""
    one = lambda c, k: F.when(F.col("a") == 255, F.col(c)).when(F.col("a") == 0, k).otherwise(blend_u8(c, "a", k)).cast("int").alias(c)
    return pixels.select(*PIXEL, *(one(c, k) for c, k in zip("rgb", back)), F.lit(255).alias("a"))


def binarise(gray: DataFrame, threshold: Column | float, invert: bool = False) -> DataFrame:
    """m is 1 for ink: levels below 255 times the threshold, or the others if inverted."""
    dark = F.col("v") < threshold * 255.0
    return gray.withColumn("m", (~dark if invert else dark).cast("int"))


def mask_from_alpha(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pixels.select(*PIXEL, (F.col("a") >= 255.0 * threshold).cast("int").alias("m"))


def premultiply(pixels: DataFrame) -> DataFrame:
    return pixels.select(*PIXEL, *(premultiplied(c, "a").alias(c) for c in "rgb"), "a")


def unpremultiply(pixels: DataFrame) -> DataFrame:
    return pixels.select(*PIXEL, *(unpremultiplied(c, "a").alias(c) for c in "rgb"), "a")


def downscale_nearest(raster: DataFrame, k: int) -> DataFrame:
    """The top left pixel of each k by k block."""
    rest = [c for c in raster.columns if c not in PIXEL]
    return raster.where((F.col("x") % k == 0) & (F.col("y") % k == 0)).select("image_id", (F.col("y") / k).cast("int").alias("y"), (F.col("x") / k).cast("int").alias("x"), *rest)


def upscale_nearest(raster: DataFrame, k: int) -> DataFrame:
    rest = [c for c in raster.columns if c not in PIXEL]
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    rows = raster.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return rows.select("image_id", (F.col("y") * k + F.col("dy")).alias("y"), (F.col("x") * k + F.col("dx")).alias("x"), *rest)


def nearest(palette: list[Colour], colours: DataFrame) -> DataFrame:
    """label and squared weighted distance d2 of the nearest palette colour; the first of equal ones."""
    rgb = tuple(F.col(c) for c in "rgb")
    best = F.array_min(F.array(*(F.struct(weighted_distance2(rgb, p).alias("d2"), F.lit(j).alias("label")) for j, p in enumerate(palette))))
    return colours.withColumn("__best", best).select(*colours.columns, F.col("__best.label").alias("label"), F.col("__best.d2").alias("d2"))


def assign_labels(pixels: DataFrame, palette: list[Colour], background: int = 0) -> DataFrame:
    """Label of each pixel; pixels of an alpha under 128 get the background's."""
    found = nearest(palette, pixels)
    return found.select(*PIXEL, F.when(F.col("a") < 128, background).otherwise(F.col("label")).alias("label"), "a", "d2")


def diff_heatmap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where two rasters differ by more than 16 in a channel: yellow over orange to red, more opaque the more they differ."""
    other = b.select(*PIXEL, *(F.col(c).alias(f"{c}2") for c in "rgb"))
    m = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"))
    rows = a.join(other, PIXEL).select(*PIXEL, m.alias("m"))
    # Where the ramp's colours are, as shares of the largest difference.
    ramp = [(0.3, (255, 214, 0)), (0.45, (255, 122, 0)), (0.6, (224, 24, 24))]
    t = F.col("m") / F.lit(255.0)

    def channel(k: int) -> Column:
        (t0, c0), (t1, c1), (t2, c2) = ((s, c[k]) for s, c in ramp)
        mixed = lambda s, p, e, q: F.bround(F.lit(float(p)) + F.lit(float(q - p)) * (t - s) / (e - s))
        return F.when(t < t0, c0).when(t >= t2, c2).when(t < t1, mixed(t0, c0, t1, c1)).otherwise(mixed(t1, c1, t2, c2)).cast("int")

    seen = F.col("m") > 16
    return rows.select(*PIXEL, *(F.when(seen, channel(k)).otherwise(0).alias(c) for k, c in enumerate("rgb")), F.when(seen, F.least(F.lit(255), F.col("m") * 3)).otherwise(0).cast("int").alias("a"))


def level_at(pixels: DataFrame, low: float, high: float, spread: int = 12, tolerance: int = 8) -> DataFrame:
    """Level 0 or 1 of neutral pixels near one of two grays, else null."""
    neutral = F.greatest("r", "g", "b") - F.least("r", "g", "b") <= spread
    y = luma()
    level = F.when(neutral & (F.abs(y - low) <= tolerance), 0).when(neutral & (F.abs(y - high) <= tolerance), 1)
    return pixels.select(*PIXEL, level.alias("level"))


def border_band(raster: DataFrame, width: Column, height: Column, band: int = 3) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return raster.where((x < band) | (y < band) | (x >= width - band) | (y >= height - band))


def sizes(raster: DataFrame) -> DataFrame:
    return raster.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count("*").alias("n"))


def uniformity(pixels: DataFrame) -> DataFrame:
    """Whether all pixels of an image are equal, have one alpha, and are all opaque."""
    same = lambda cs: F.min(F.struct(*cs)) == F.max(F.struct(*cs))
    return pixels.groupBy("image_id").agg(same(["r", "g", "b", "a"]).alias("uniform"), same(["a"]).alias("alpha_uniform"), (F.min("a") == 255).alias("full"))


def stride_sample(pixels: DataFrame, sample: int = 20000, width: int | None = None) -> DataFrame:
    """Every so many pixels in raster order, opaque ones only: the same rows each time."""
    s = sizes(pixels).select("image_id", F.col("width").alias("w"), F.greatest(F.lit(1), F.floor(F.col("n") / sample)).alias("stride"))
    rows = pixels.join(s, "image_id")
    return rows.where(((F.col("y") * F.col("w") + F.col("x")) % F.col("stride") == 0) & (F.col("a") >= 128)).select(pixels.columns)


def mask_to_raster(mask: DataFrame) -> DataFrame:
    level = F.when(F.col("m") == 1, 0).otherwise(255)
    return mask.select(*PIXEL, *(level.alias(c) for c in "rgb"), F.lit(255).alias("a"))
