"""Masks, labels, layers and regions as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pointwise import PIXEL
from .stencil import neighbour


def by():
    return Window.partitionBy("image_id")


def layer_order(labels: DataFrame) -> DataFrame:
    """image_id, label, n, rank: largest first, the lower label of equal ones."""
    counts = labels.groupBy("image_id", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(by().orderBy(F.desc("n"), "label")) - 1)


def ranked(labels: DataFrame, order: DataFrame) -> DataFrame:
    """Pixels with the rank of their label; labels without one are at the bottom."""
    return labels.join(order.select("image_id", "label", "rank"), ["image_id", "label"], "left").select(*PIXEL, F.coalesce("rank", F.lit(0)).alias("rank"))


def nested_masks(ranks: DataFrame) -> DataFrame:
    """Ink of each layer, stacked: layer j is all of rank j or more."""
    return ranks.select(*PIXEL, F.explode(F.sequence(F.lit(0), "rank")).alias("layer"))


def cutout_masks(ranks: DataFrame) -> DataFrame:
    """Ink of each layer, cut out and grown by one pixel: a pixel is of the layers of its own rank and of its four neighbours'."""
    cross = F.array(*(neighbour(F.col("rank"), *at, F.lit(None)) for at in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))
    return ranks.select(*PIXEL, cross.alias("cross")).select(*PIXEL, F.explode(F.array_distinct(F.array_compact("cross"))).alias("layer"))


def region_mask(ranks: DataFrame, layer: int, cutout: bool, dilate: int = 1) -> DataFrame:
    """Ink of a layer: rank j or more; cut out, only what is within a city-block distance of rank j."""
    above = ranks.where(F.col("rank") >= layer).select(*PIXEL)
    if not cutout:
        return above
    steps = [(dy, dx) for dy in range(-dilate, dilate + 1) for dx in range(abs(dy) - dilate, dilate - abs(dy) + 1)]
    step = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))).alias("d")
    near = ranks.where(F.col("rank") == layer).select(*PIXEL, step).select("image_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).distinct()
    return above.join(near, PIXEL, "left_semi")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*PIXEL), PIXEL, "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).unionByName(b.select(*PIXEL)).distinct()


def complement(raster: DataFrame, ink: DataFrame) -> DataFrame:
    return raster.join(ink.select(*PIXEL), PIXEL, "left_anti")


def ink_count(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image_id").agg(F.sum("m").cast("long").alias("ink"), (F.max("m") == 1).alias("has_ink"))


def ink_box(gray: DataFrame, background: Column | float, tolerance: float = 24.0, grow: float = 0.05) -> DataFrame:
    """Half-open box of the levels off the background, grown by a share of the longer side; the whole image if there are none."""
    off = F.abs(F.col("v") - background) > tolerance
    s = gray.groupBy("image_id").agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"),
        *(f(F.when(off, F.col(c))).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "lo_"), (F.max, "hi_"))),
    )
    pad = F.floor(grow * F.greatest("w", "h") + 0.5).cast("int")
    hi = lambda c, side: F.when(F.col(f"hi_{c}").isNull(), F.col(side)).otherwise(F.least(F.col(side), F.col(f"hi_{c}") + 1 + pad))
    lo = lambda c: F.when(F.col(f"lo_{c}").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col(f"lo_{c}") - pad))
    return s.select("image_id", lo("x").alias("x0"), lo("y").alias("y0"), hi("x", "w").alias("x1"), hi("y", "h").alias("y1"))


def region_adjacency(regions: DataFrame) -> DataFrame:
    """Pairs a < b of regions with pixels side by side, and the length of their border."""
    region = F.col("region")
    pairs = F.array(*(F.struct(F.least(region, n).alias("a"), F.greatest(region, n).alias("b")) for n in (neighbour(region, 0, 1, F.lit(None)), neighbour(region, 1, 0, F.lit(None)))))
    rows = regions.select("image_id", "region", pairs.alias("pairs")).select("image_id", "region", F.explode("pairs").alias("p")).where("p.a <> p.b AND region IS NOT NULL")
    both = rows.where("p.a = region OR p.b = region")
    return both.groupBy("image_id", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("length"))


def moments(pixels: DataFrame, by: tuple[str, ...] = ("image_id", "region")) -> DataFrame:
    """Sixteen sums over the pixels of each region, at their centres; exact in doubles."""
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    c = {k: F.col(k).cast("double") for k in "rgb"}
    sums = {"n": F.count("*").cast("double"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "sxy": F.sum(x * y), "syy": F.sum(y * y)}
    for k, v in c.items():
        sums |= {f"s{k}": F.sum(v), f"sx{k}": F.sum(x * v), f"sy{k}": F.sum(y * v)}
    sums["scc"] = F.sum(sum((v * v for v in list(c.values())[1:]), c["r"] * c["r"]))
    return pixels.groupBy(*by).agg(*(v.alias(k) for k, v in sums.items()))


def flat_fit(m: DataFrame) -> DataFrame:
    """Mean colour and pooled error of each region from its moments."""
    n = F.col("n")
    sse = F.col("scc") - sum((F.col(f"s{k}") * F.col(f"s{k}") for k in "gb"), F.col("sr") * F.col("sr")) / n
    return m.select("*", *((F.col(f"s{k}") / n).alias(f"mean_{k}") for k in "rgb"), F.sqrt(F.greatest(F.lit(0.0), sse) / (3 * n)).alias("rmse_flat"))


def plane_fit(m: DataFrame) -> DataFrame:
    """Slopes of each channel over the plane and the pooled error; null where the region is too thin."""
    n = F.col("n")
    vxx, vyy, vxy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n, F.col("sxy") - F.col("sx") * F.col("sy") / n
    det = vxx * vyy - vxy * vxy
    solid = (vxx > 1e-6 * n) & (vyy > 1e-6 * n) & (det > 1e-9 * vxx * vyy)
    d = F.when(solid, det)
    out, explained = [], F.lit(0.0)
    for k in "rgb":
        cx, cy = F.col(f"sx{k}") - F.col("sx") * F.col(f"s{k}") / n, F.col(f"sy{k}") - F.col("sy") * F.col(f"s{k}") / n
        gx, gy = (cx * vyy - cy * vxy) / d, (cy * vxx - cx * vxy) / d
        out += [gx.alias(f"gx_{k}"), gy.alias(f"gy_{k}")]
        explained = explained + gx * cx + gy * cy
    sse = F.col("scc") - sum((F.col(f"s{k}") ** 2 for k in "gb"), F.col("sr") ** 2) / n - explained
    return m.select("*", *out, F.sqrt(F.greatest(F.lit(0.0), sse) / (3 * n)).alias("rmse_plane"))


def plane_axis(planes: DataFrame) -> DataFrame:
    """Direction in which a plane's colour changes most, and how fast; to the right, or down if it is vertical."""
    sums = lambda a, b: sum((F.col(f"{a}_{k}") * F.col(f"{b}_{k}") for k in "gb"), F.col(f"{a}_r") * F.col(f"{b}_r"))
    xx, xy, yy = sums("gx", "gx"), sums("gx", "gy"), sums("gy", "gy")
    angle = F.atan2(2 * xy, xx - yy) / 2
    strength = F.sqrt(F.greatest(F.lit(0.0), (xx + yy + F.hypot(xx - yy, 2 * xy)) / 2))
    flip = F.when((F.cos(angle) < 0) | ((F.cos(angle) == 0) & (F.sin(angle) < 0)), -1.0).otherwise(1.0)
    return planes.select("*", (F.cos(angle) * flip).alias("ux"), (F.sin(angle) * flip).alias("uy"), strength.alias("strength"))


def merge_regions(regions: DataFrame, parents: DataFrame) -> DataFrame:
    """Pixels under the regions that theirs were merged into (image_id, region, into), numbered anew in order of the smallest member."""
    joined = regions.join(parents, ["image_id", "region"], "left").withColumn("into", F.coalesce("into", "region"))
    first = joined.groupBy("image_id", "into").agg(F.min("region").alias("least"))
    number = first.select("image_id", "into", (F.dense_rank().over(by().orderBy("least")) - 1).alias("new"))
    return joined.join(number, ["image_id", "into"]).select(*PIXEL, F.col("new").alias("region"))
