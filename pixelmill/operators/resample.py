"""Box reduction, Gaussian blur and bicubic enlargement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import store_u8
from .pointwise import sizes


def downscale_box(raster: DataFrame, f: int, columns: tuple[str, ...] = ("v",), store: bool = False) -> DataFrame:
    """Mean of each f by f block; blocks at the edge are smaller."""
    rows = raster.groupBy("image_id", F.floor(F.col("y") / f).cast("int").alias("y"), F.floor(F.col("x") / f).cast("int").alias("x")).agg(*(F.avg(c).alias(c) for c in columns))
    return rows.select("image_id", "y", "x", *(store_u8(c).alias(c) for c in columns)) if store else rows


def kernel(sigma: float) -> list[float]:
    """Normalised weights of a Gaussian out to three sigma."""
    radius = math.ceil(3 * sigma)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _along(lines: DataFrame, by: str, at: str, weights: list[float]) -> DataFrame:
    """Weighted sums along lines; beyond an end its last value goes on. Lines are arrays, so taps need no join."""
    radius = len(weights) // 2
    line = lines.groupBy("image_id", by).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, "v"))), lambda s: s["v"].cast("double")).alias("line"))  # at most a side's length

    def value(i: Column) -> Column:
        taps = (F.lit(w) * F.element_at("line", F.least(F.size("line"), F.greatest(F.lit(1), i + (k - radius + 1)))) for k, w in enumerate(weights))
        total = next(taps)
        for t in taps:
            total = total + t
        return total

    return line.select("image_id", by, F.posexplode(F.transform(F.sequence(F.lit(0), F.size("line") - 1), value)).alias(at, "v"))


def gaussian_blur(gray: DataFrame, sigma: float) -> DataFrame:
    if sigma <= 0:
        return gray.select("image_id", "y", "x", F.col("v").cast("double").alias("v"))
    w = kernel(sigma)
    return _along(_along(gray, "y", "x", w), "x", "y", w).select("image_id", "y", "x", "v")


def taps(side: Column, u: int) -> Column:
    """For each enlarged place: source places, weights and whether they are the two nearest, of a Catmull-Rom spline."""

    def of(d: Column) -> Column:
        c = (d + 0.5) / u - 0.5
        base = F.floor(c).cast("int")
        t = c - base
        w = [((-0.5 * t + 1.0) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1.0, ((-1.5 * t + 2.0) * t + 0.5) * t, (0.5 * t - 0.5) * t * t]
        return F.array(*(F.struct(d.alias("d"), F.least(side - 1, F.greatest(F.lit(0), base + (k - 1))).alias("i"), w[k].alias("w"), F.lit(k in (1, 2)).alias("near")) for k in range(4)))

    return F.flatten(F.transform(F.sequence(F.lit(0), side * u - 1), of))


def upscale(gray: DataFrame, u: int, store: bool = False) -> DataFrame:
    """Bicubic enlargement; each value stays within its four nearest pixels."""
    s = sizes(gray)
    tx = s.select("image_id", F.inline(taps(F.col("width"), u))).toDF("image_id", "to_x", "x", "w", "near")
    ty = s.select("image_id", F.inline(taps(F.col("height"), u))).toDF("image_id", "to_y", "y", "w", "near")
    near = lambda f, c: f(F.when(F.col("near"), F.col(c)))
    rows = gray.join(tx, ["image_id", "x"]).groupBy("image_id", "y", "to_x").agg(F.sum(F.col("w") * F.col("v")).alias("v"), near(F.min, "v").alias("lo"), near(F.max, "v").alias("hi"))
    out = rows.join(ty, ["image_id", "y"]).groupBy("image_id", "to_y", "to_x").agg(F.sum(F.col("w") * F.col("v")).alias("v"), near(F.min, "lo").alias("lo"), near(F.max, "hi").alias("hi"))
    v = F.least("hi", F.greatest("lo", "v"))
    return out.select("image_id", F.col("to_y").alias("y"), F.col("to_x").alias("x"), (store_u8(v) if store else v).alias("v"))


def detect_grid(pixels: DataFrame, largest: int = 8) -> DataFrame:
    """The largest block side, 8 to 2, that divides both sides and whose blocks each have one colour; else 1."""
    s = sizes(pixels).select("image_id", "width", "height")
    ks = F.filter(F.array(*map(F.lit, range(2, largest + 1))), lambda k: (F.col("width") % k == 0) & (F.col("height") % k == 0))
    tried = pixels.join(s.withColumn("k", F.explode(ks)), "image_id")
    rgba = F.struct("r", "g", "b", "a")
    blocks = tried.groupBy("image_id", "k", F.floor(F.col("y") / F.col("k")).alias("by"), F.floor(F.col("x") / F.col("k")).alias("bx")).agg((F.min(rgba) == F.max(rgba)).alias("same"))
    good = blocks.groupBy("image_id", "k").agg(F.bool_and("same").alias("all")).where("all").groupBy("image_id").agg(F.max("k").alias("k"))
    return s.select("image_id").join(good, "image_id", "left").select("image_id", F.coalesce("k", F.lit(1)).alias("grid"))
