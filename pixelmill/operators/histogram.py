"""Histograms, thresholds and statistics of levels, by image. All work on the histogram, of 256 rows an image at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up


def by():
    return Window.partitionBy("image_id")


def up_to():
    return by().orderBy("v").rowsBetween(Window.unboundedPreceding, 0)


def histogram256(gray: DataFrame) -> DataFrame:
    """image_id, v, n of the levels that occur: rounded half up, clamped, NaN as 0."""
    v = F.least(F.lit(255), F.greatest(F.lit(0), half_up(F.nanvl(F.col("v").cast("double"), F.lit(0.0)))))
    return gray.groupBy("image_id", v.alias("v")).agg(F.count("*").alias("n"))


def separations(hist: DataFrame) -> DataFrame:
    """For each threshold that splits an image's levels: variance between the classes, and the thresholds up to the next level that split alike."""
    cum = hist.select("image_id", "v", F.sum("n").over(up_to()).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up_to()).alias("s0"), F.sum("n").over(by()).alias("w"), F.sum(F.col("n") * F.col("v")).over(by()).alias("s"), F.lead("v").over(by().orderBy("v")).alias("up"))
    w0, s0, w, s = (F.col(c).cast("double") for c in ("w0", "s0", "w", "s"))
    gap = s0 / w0 - (s - s0) / (w - w0)
    return cum.where("up IS NOT NULL").select("image_id", "w0", "w", (F.col("v") + 1).alias("lo"), F.col("up").alias("hi"), (w0 / w * ((w - w0) / w) * gap * gap).alias("between"))


def otsu(hist: DataFrame) -> DataFrame:
    """Threshold of the largest variance between classes, the middle of equal ones; 128 for one level."""
    found = separations(hist).withColumn("top", F.max("between").over(by())).where("between = top")
    best = found.groupBy("image_id").agg(F.floor((F.min("lo") + F.max("hi") + 1) / 2).cast("int").alias("t"), F.max("between").alias("between"))
    return hist.select("image_id").distinct().join(best, "image_id", "left").select("image_id", F.coalesce("t", F.lit(128)).alias("t"), F.coalesce("between", F.lit(0.0)).alias("between"))


def class_percentile(hist: DataFrame, lo: Column | int, hi: Column | int, q: float, from_top: bool = False) -> DataFrame:
    """The level of lo..hi at which the count so far, from below or above, reaches a share q."""
    part = hist.where((F.col("v") >= lo) & (F.col("v") <= hi))
    order = by().orderBy(F.desc("v") if from_top else "v").rowsBetween(Window.unboundedPreceding, 0)
    reached = part.withColumn("c", F.sum("n").over(order)).withColumn("total", F.sum("n").over(by())).where(F.col("c") >= q * F.col("total"))
    return reached.groupBy("image_id").agg((F.max if from_top else F.min)("v").alias("v"))


def iso_threshold(gray: DataFrame, offset: float = 0.0, invert: bool = False) -> DataFrame:
    """Threshold between ink and paper as a share of 255: the middle of the ink's 5th percentile, from its far end, and
    the paper's median if they are 24 apart, else Otsu's within 0.35 and 0.65; then the offset, within 0.02 and 0.98."""
    hist = histogram256(gray)
    t = otsu(hist)
    marked = hist.join(t, "image_id")
    dark, bright = (F.lit(0), F.col("t") - 1), (F.col("t"), F.lit(255))
    ink = class_percentile(marked, *(bright if invert else dark), 0.05, invert).withColumnRenamed("v", "ink")
    paper = class_percentile(marked, *(dark if invert else bright), 0.5).withColumnRenamed("v", "paper")
    rows = t.join(ink, "image_id", "left").join(paper, "image_id", "left")
    apart = F.coalesce(F.abs(F.col("paper") - F.col("ink")) >= 24, F.lit(False))
    base = F.when(apart, (F.col("ink") + F.col("paper")) / F.lit(510.0)).otherwise(F.least(F.lit(0.65), F.greatest(F.lit(0.35), F.col("t") / F.lit(255.0))))
    return rows.select("image_id", "t", "ink", "paper", F.least(F.lit(0.98), F.greatest(F.lit(0.02), base + offset)).alias("threshold"))


def bimodality(hist: DataFrame) -> DataFrame:
    """Separability (variance between classes over all) and whether there are two compact classes."""
    rows = hist.join(otsu(hist), "image_id")
    low = F.col("v") < F.col("t")
    n, v = F.col("n"), F.col("v").cast("double")
    power = lambda k, c: F.sum(F.when(c, n * v**k).otherwise(0.0))
    every = F.lit(True)
    stats = rows.groupBy("image_id").agg(F.max("between").alias("between"), *(power(k, c).alias(f"p{k}{name}") for k in range(3) for name, c in (("", every), ("l", low), ("h", ~low))))
    mean = lambda c: F.col(f"p1{c}") / F.when(F.col(f"p0{c}") > 0, F.col(f"p0{c}"))
    var = lambda c: F.greatest(F.lit(0.0), F.col(f"p2{c}") / F.when(F.col(f"p0{c}") > 0, F.col(f"p0{c}")) - mean(c) * mean(c))
    share = F.when(var("") > 0, F.col("between") / F.when(var("") > 0, var(""))).otherwise(0.0)
    compact = F.sqrt(F.greatest(var("l"), var("h"))) <= 0.25 * (mean("h") - mean("l"))
    return stats.select("image_id", share.alias("separability"), F.coalesce((share >= 0.6) & compact, F.lit(False)).alias("bimodal"))


def two_peaks(hist: DataFrame) -> DataFrame:
    """The level with most counts within 3 of it, and the next such level, a local maximum 8 or more away."""
    spine = hist.sparkSession.range(256).select(F.col("id").cast("int").alias("v"))
    dense = hist.select("image_id").distinct().crossJoin(F.broadcast(spine)).join(hist, ["image_id", "v"], "left").na.fill(0, ["n"])  # 256 rows an image
    w = by().orderBy("v")
    s = dense.withColumn("c", F.sum("n").over(w.rowsBetween(-3, 3)))
    s = s.withColumn("before", F.coalesce(F.lag("c").over(w), F.lit(-1))).withColumn("after", F.coalesce(F.lead("c").over(w), F.lit(-1)))
    s = s.withColumn("first", F.max(F.struct("c", (-F.col("v")).alias("m"))).over(by()))
    peak = -F.col("first.m")
    far = (F.abs(F.col("v") - peak) >= 8) & (F.col("c") >= F.col("before")) & (F.col("c") >= F.col("after")) & (F.col("c") > 0)
    out = s.groupBy("image_id").agg(F.max(peak).alias("p0"), F.max(F.when(far, F.struct("c", (-F.col("v")).alias("m")))).alias("second"))
    return out.select("image_id", "p0", (-F.col("second.m")).alias("p1"))


def alpha_shares(pixels: DataFrame) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return pixels.groupBy("image_id").agg(share(F.col("a") < 8).alias("transparent"), share((F.col("a") >= 8) & (F.col("a") <= 247)).alias("partial"))


def quantile_pair(values: DataFrame, lo: float, hi: float, key: str = "image_id", v: str = "v") -> DataFrame:
    """Quantiles at rank q (n - 1), interpolated."""
    q = F.percentile(v, F.array(F.lit(lo), F.lit(hi)))
    return values.groupBy(key).agg(q.alias("q")).select(key, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
