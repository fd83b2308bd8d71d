"""Neighbourhood operators on rasters of any size, images of different sizes side by side.

A raster needs one shuffle, by image: in row order every neighbour is a frame of one row at a fixed distance of the
place's number, so all eight come from a single window. A place without a pixel counts as outside the image. Wider
neighbourhoods are separable minima and maxima over rows, then columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import colour_key, luma
from .pointwise import PIXEL

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


#: More than an image has columns.
ROW = 1 << 20


def _at(v: Column, dy: int, dx: int) -> Column:
    """The value dy rows below and dx columns to the right; null where there is no pixel."""
    step = dy * ROW + dx
    raster = Window.partitionBy("image_id").orderBy(F.col("y").cast("long") * ROW + F.col("x"))
    return F.max(v).over(raster.rangeBetween(step, step)) if step else v


def neighbour(v: Column, dy: int, dx: int, outside: Column | None = None) -> Column:
    """The value dy rows below and dx columns to the right; outside the image this, or else the nearest pixel's."""
    if outside is not None:
        return F.coalesce(_at(v, dy, dx), outside)
    return F.coalesce(*(_at(v, *at) for at in dict.fromkeys([(dy, dx), (dy, 0), (0, dx), (0, 0)])))


def with_around(raster: DataFrame, columns: list[str], outside: Column | None = None) -> DataFrame:
    """raster with columns c_0 .. c_8 of the 3 x 3 pixels around each, in row order."""
    whole = F.struct(*columns)
    rows = raster.select("*", *(_at(whole, dy, dx).alias(f"__{i}") for i, (dy, dx) in enumerate(AROUND)))
    of = lambda i, c: F.col(f"__{i}")[c]
    picked = []
    for c in columns:
        for i, (dy, dx) in enumerate(AROUND):
            near = [AROUND.index(at) for at in dict.fromkeys([(dy, dx), (dy, 0), (0, dx), (0, 0)])]
            found = F.coalesce(*(of(k, c) for k in near)) if outside is None else F.when(F.col(f"__{i}").isNotNull(), of(i, c)).otherwise(outside)
            picked.append(found.alias(f"{c}_{i}"))
    return rows.select(*raster.columns, *picked)


def erode1(mask: DataFrame) -> DataFrame:
    """Ink whose four neighbours are ink; outside is none."""
    zero = F.lit(0)
    m = F.col("m")
    return mask.withColumn("m", F.least(m, *(neighbour(m, dy, dx, zero) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)))))


def dilate1(mask: DataFrame) -> DataFrame:
    zero = F.lit(0)
    m = F.col("m")
    return mask.withColumn("m", F.greatest(m, *(neighbour(m, dy, dx, zero) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)))))


def sobel_of(c: str) -> tuple[Column, Column]:
    """Horizontal and vertical gradients, divided by four, from the columns of with_around."""
    p = [F.col(f"{c}_{i}").cast("double") for i in range(9)]
    return (p[2] + 2 * p[5] + p[8] - p[0] - 2 * p[3] - p[6]) / 4, (p[6] + 2 * p[7] + p[8] - p[0] - 2 * p[1] - p[2]) / 4


def magnitude(c: str) -> Column:
    gx, gy = sobel_of(c)
    return F.sqrt(gx * gx + gy * gy)


def laplacian_of(c: str) -> Column:
    p = [F.col(f"{c}_{i}").cast("double") for i in range(9)]
    return F.abs(sum(p[1:], p[0]) - 9 * p[4]) / 8


def sobel(gray: DataFrame) -> DataFrame:
    return with_around(gray, ["v"]).select(*gray.columns, *(g.alias(n) for g, n in zip(sobel_of("v"), ("gx", "gy"))), magnitude("v").alias("magnitude"))


def edge_maps(pixels: DataFrame, with_alpha: bool = False) -> DataFrame:
    """The largest gradient and the largest Laplacian over the channels."""
    channels = [*"rgb", *["a"] * with_alpha]
    rows = with_around(pixels, channels)
    return rows.select(*PIXEL, F.greatest(*(magnitude(c) for c in channels)).alias("sobel"), F.greatest(*(laplacian_of(c) for c in channels)).alias("laplacian"))


def _separable(raster: DataFrame, column: str, radius: int, aggregate: Callable, out: str) -> DataFrame:
    """Aggregate over the square around each pixel, cut off at the image's edge."""
    along_x = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-radius, radius)
    along_y = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-radius, radius)
    return raster.withColumn("__s", aggregate(column).over(along_x)).withColumn(out, aggregate("__s").over(along_y)).drop("__s")


def square_min(raster: DataFrame, column: str, radius: int, out: str) -> DataFrame:
    return _separable(raster, column, radius, F.min, out)


def square_max(raster: DataFrame, column: str, radius: int, out: str) -> DataFrame:
    return _separable(raster, column, radius, F.max, out)


# How edge thresholds follow from the noise.
LAP_HI_MIN, LAP_HI_PER_SIGMA, LAP_LO_RATIO = 6.0, 7.2, 0.45
SOB_HI_MIN, SOB_HI_PER_SIGMA, SOB_LO_RATIO = 24.0, 9.0, 0.4


def edge_thresholds(sigma: Column, detail: float = 1.0) -> dict[str, Column]:
    lap, sob = F.greatest(F.lit(LAP_HI_MIN), sigma * LAP_HI_PER_SIGMA) / detail, F.greatest(F.lit(SOB_HI_MIN), sigma * SOB_HI_PER_SIGMA) / detail
    return {"lap_hi": lap, "lap_lo": lap * LAP_LO_RATIO, "sob_hi": sob, "sob_lo": sob * SOB_LO_RATIO}


def gate_sobel(maps: DataFrame, limits: dict[str, Column | float]) -> DataFrame:
    """Weak gradients (between the limits) that stand out from their surroundings become seeds if no strong edge is near
    and stay if one is; others stay only where the Laplacian is active. All other gradients stay."""
    rows = square_min(square_max(maps, "sobel", 3, "near_sobel"), "sobel", 2, "floor")
    rows = square_max(square_max(rows, "laplacian", 3, "near_laplacian"), "laplacian", 1, "active")
    v = F.col("sobel")
    weak = (v > limits["sob_lo"]) & (v <= limits["sob_hi"])
    strong = (F.col("near_sobel") > limits["sob_hi"]) | (F.col("near_laplacian") > limits["lap_hi"])
    gated = F.when(~weak, v).when(v - F.col("floor") > limits["sob_lo"], F.when(strong, v).otherwise(float("inf"))).when(F.col("active") > limits["lap_lo"], v).otherwise(0.0)
    return rows.select(*PIXEL, "laplacian", gated.alias("sobel"))


def deep_band(regions: DataFrame, depth: int) -> DataFrame:
    """Pixels around which, up to the image's edge, all within depth are of one region."""
    rows = square_max(square_min(regions, "region", depth, "lo"), "region", depth, "hi")
    return rows.where("lo = hi").select(regions.columns)


def thin_stroke_share(mask: DataFrame) -> DataFrame:
    """Share of the ink that an erosion removes."""
    both = erode1(mask.withColumn("ink", F.col("m")))
    s = both.groupBy("image_id").agg(F.sum("ink").alias("ink"), F.sum("m").alias("core"))
    return s.select("image_id", "ink", "core", F.when(F.col("ink") > 0, 1 - F.col("core") / F.col("ink")).otherwise(0.0).alias("thin"))


def perimeter(mask: DataFrame) -> DataFrame:
    """Changes between neighbours, times pi / 4."""
    m = F.col("m")
    right, down = ((_at(m, *at) != m).cast("int") for at in ((0, 1), (1, 0)))
    n = F.coalesce(right, F.lit(0)) + F.coalesce(down, F.lit(0))
    return mask.select("image_id", n.alias("n")).groupBy("image_id").agg((F.sum("n") * F.pi() / 4).alias("perimeter"))


def hard_edge_share(gray: DataFrame, tolerance: float = 12.0, edge: float = 64.0) -> DataFrame:
    """Of pixels on strong edges, the share without a blended pixel in their 3 x 3.

    A pixel is blended if its level lies between the darkest and lightest of its 3 x 3, farther than tolerance from both.
    """
    p = [F.col(f"v_{i}") for i in range(9)]
    rows = with_around(gray, ["v"])
    lo, hi = F.least(*p), F.greatest(*p)
    blended = ((F.col("v") - lo > tolerance) & (hi - F.col("v") > tolerance)).cast("int")
    rows = rows.select("image_id", "y", "x", magnitude("v").alias("magnitude"), blended.alias("blended"))
    soft = F.greatest(*(neighbour(F.col("blended"), dy, dx, F.lit(0)) for dy, dx in AROUND))
    rows = rows.withColumn("soft", soft).where(F.col("magnitude") > edge)
    return rows.groupBy("image_id").agg(F.avg((F.col("soft") == 0).cast("double")).alias("hard"), F.count("*").alias("edges"))


def noise_sigma(pixels: DataFrame) -> DataFrame:
    """Noise from the mean response of a kernel that ignores ramps, over opaque inner pixels: all, and those without a strong edge in their 3 x 3."""
    around = with_around(pixels.select(*PIXEL, luma().cast("double").alias("v"), "a"), ["v", "a"])
    p = [F.col(f"v_{i}") for i in range(9)]
    response = F.abs(p[0] + p[2] + p[6] + p[8] - 2 * (p[1] + p[3] + p[5] + p[7]) + 4 * p[4])
    opaque = F.least(*(F.col(f"a_{i}") for i in range(9))) >= 250
    rows = around.select(*PIXEL, response.alias("response"), magnitude("v").alias("magnitude"), opaque.alias("opaque"))
    rows = square_max(rows, "magnitude", 1, "near")
    image = Window.partitionBy("image_id")
    rows = rows.withColumn("bottom", F.max("y").over(image)).withColumn("right", F.max("x").over(image))
    inner = rows.where("x > 0 AND x < right AND y > 0 AND y < bottom AND opaque")
    factor = F.sqrt(F.pi() / 2) / 6
    inner = inner.withColumn("sigma_all", F.avg("response").over(Window.partitionBy("image_id")) * factor)
    calm = F.when(F.col("near") <= F.greatest(F.lit(24.0), 3 * F.col("sigma_all")), F.col("response"))
    return inner.groupBy("image_id").agg(F.max("sigma_all").alias("sigma_all"), F.coalesce(F.avg(calm) * factor, F.max("sigma_all")).alias("sigma"))


def edge_pixels_per_bin(pixels: DataFrame, step: int = 32) -> DataFrame:
    """Pixels of each five-bit colour that differ in a channel from one of their four neighbours."""
    differs = F.greatest(*(F.abs(F.col(c) - neighbour(F.col(c), dy, dx)) for c in "rgb" for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    rows = pixels.select("image_id", colour_key().alias("key"), (differs > step).cast("long").alias("edge"), "a").where("a >= 128")
    return rows.groupBy("image_id", "key").agg(F.count("*").alias("n"), F.sum("edge").alias("edges"))


def ramp_pixels_per_bin(pixels: DataFrame, span: int = 24, off: float = 12.0, margin: float = 4.0) -> DataFrame:
    """Pixels of each five-bit colour that lie on the line between two opposite neighbours, away from both."""
    rows = with_around(pixels, list("rgb"), F.lit(None))
    tests = []
    for i, j in ((3, 5), (1, 7), (0, 8), (2, 6)):
        d = [F.col(f"{c}_{j}") - F.col(f"{c}_{i}") for c in "rgb"]
        e = [F.col(c) - F.col(f"{c}_{i}") for c in "rgb"]
        dd, de, ee = (sum((x * y for x, y in zip(p[1:], q[1:])), p[0] * q[0]).cast("double") for p, q in ((d, d), (d, e), (e, e)))
        length = F.sqrt(dd)
        along = de / F.when(dd > 0, length)
        tests.append(F.coalesce((dd >= span * span) & (along >= margin) & (along <= length - margin) & (ee - along * along < off * off), F.lit(False)))
    on = tests[0] | tests[1] | tests[2] | tests[3]
    rows = rows.where("a >= 128").select("image_id", colour_key().alias("key"), on.cast("long").alias("ramp"))
    return rows.groupBy("image_id", "key").agg(F.count("*").alias("n"), F.sum("ramp").alias("ramps"))


def core_counts(labels: DataFrame) -> DataFrame:
    """Population of each label and how many of its pixels are surrounded by it."""
    same = F.lit(True)
    for dy, dx in AROUND:
        same = same & (neighbour(F.col("label"), dy, dx) == F.col("label"))
    rows = labels.select("image_id", "label", same.cast("long").alias("core"))
    return rows.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.sum("core").alias("core"))


def line_transitions(levels: DataFrame, gap: int = 4) -> DataFrame:
    """Where the last known level along a row changes, at most gap pixels apart, with the crossing between them."""
    before = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("level").isNotNull(), F.struct("x", "level")), ignorenulls=True).over(before)
    rows = levels.withColumn("before", last).where("level IS NOT NULL AND before IS NOT NULL AND level <> before.level").where(F.col("x") - F.col("before.x") <= gap)
    return rows.select("image_id", "y", ((F.col("x") + F.col("before.x") + 1) / 2).alias("crossing"))


def phase_coherence(positions: DataFrame, periods: list[float], at: str = "crossing") -> DataFrame:
    """How well positions agree modulo each period, and where."""
    cells = positions.withColumn("cell", F.explode(F.array(*map(F.lit, map(float, periods)))))
    angle = 2 * F.pi() * F.col(at) / F.col("cell")
    sums = cells.groupBy("image_id", "cell").agg(F.sum(F.cos(angle)).alias("c"), F.sum(F.sin(angle)).alias("s"), F.count("*").alias("n"))
    phase = F.atan2("s", "c") / (2 * F.pi()) * F.col("cell")
    return sums.select("image_id", "cell", "n", (F.hypot("c", "s") / F.col("n")).alias("coherence"), F.pmod(phase + F.col("cell"), F.col("cell")).alias("offset"))
