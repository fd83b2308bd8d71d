"""Tracing parameters: defaults, clamps and derived values, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default, least and greatest of the numeric parameters.
LIMITS = {
    "blur_k": (0.35, 0.0, 1.0), "threshold_offset": (0.0, -0.25, 0.25), "alphamax": (1.0, 0.0, 1.334), "opttolerance": (0.2, 0.01, 1.0),
    "turdsize": (2.0, 0.0, 100.0), "region_detail": (1.0, 0.5, 2.0), "max_stops": (8.0, 2.0, 8.0),
}
TURN_POLICIES = ("black", "white", "left", "right", "minority", "majority")
LARGEST_AREA = 16e6


def clamped(v: Column, default: float, lo: float, hi: float) -> Column:
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(usable, F.least(F.lit(hi), F.greatest(F.lit(lo), v))).otherwise(default)


def largest_upscale(width: Column, height: Column) -> Column:
    area = (width * height).cast("double")
    return F.when(area > 0, F.greatest(F.lit(1), F.floor(F.sqrt(F.lit(LARGEST_AREA) / F.when(area > 0, area))))).otherwise(1).cast("int")


def choose_upscale(width: Column, height: Column, requested: Column) -> tuple[Column, Column]:
    """(factor, whether it had to be reduced); a null request is automatic."""
    most, side = largest_upscale(width, height), F.least(width, height)
    wanted = F.when(requested.isNull(), F.when(side <= 512, 4).when(side <= 1024, 2).otherwise(most)).otherwise(F.greatest(F.lit(1), F.floor(requested))).cast("int")
    empty = width * height <= 0
    return F.when(empty, 1).otherwise(F.least(wanted, most)).cast("int"), ~empty & (most < wanted)


def proxy_factor(width: Column, height: Column, largest: int = 256) -> Column:
    side = F.greatest(width, height)
    return F.when(side <= largest, 1).otherwise(F.ceil(side / largest)).cast("int")


def gradient_proxy_factor(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(width * height / F.lit(4e6)))).cast("int")


def resolve(params: DataFrame) -> DataFrame:
    """Every parameter with its default where it is null or unusable. params: any of the names of LIMITS, mode, engine,
    turnpolicy, layering, colors and upscale (null: automatic), width and height."""
    has = lambda c, kind="double": F.col(c) if c in params.columns else F.lit(None).cast(kind)
    mode = F.when(has("mode", "string").isin("lines", "flat", "gradient", "pixel"), has("mode", "string")).otherwise("lines")
    pixel = mode == "pixel"
    u, capped = choose_upscale(F.col("width"), F.col("height"), has("upscale"))
    u = F.when(pixel, 1).otherwise(u)
    value = {k: clamped(has(k).cast("double"), F.when(pixel, 0.0).otherwise(d) if k == "blur_k" else F.lit(d), lo, hi) for k, (d, lo, hi) in LIMITS.items()}
    value["max_stops"] = F.floor(value["max_stops"] + 0.5).cast("int")
    colours = has("colors")
    keep = [c for c in params.columns if c not in {*LIMITS, "mode", "engine", "turnpolicy", "layering", "colors", "upscale"}]
    return params.select(
        *keep, mode.alias("mode"), *(v.alias(k) for k, v in value.items()), u.alias("upscale"), (capped & ~pixel).alias("upscale_capped"),
        F.when(pixel, 0.0).otherwise(value["blur_k"] * u).alias("sigma"), (value["turdsize"] * u * u).alias("turdsize_scaled"),
        F.when(colours.isNotNull(), F.floor(F.least(F.lit(32.0), F.greatest(F.lit(2.0), colours)) + 0.5).cast("int")).alias("colors"),
        F.when(has("engine", "string").isin("potrace", "vtracer"), has("engine", "string")).otherwise("potrace").alias("engine"),
        F.when(has("turnpolicy", "string").isin(*TURN_POLICIES), has("turnpolicy", "string")).otherwise("minority").alias("turnpolicy"),
        F.when(F.coalesce(has("layering", "string"), F.when(mode == "gradient", "cutout").otherwise("stacked")) == "cutout", "cutout").otherwise("stacked").alias("layering"),
    )


def merge(base: DataFrame, over: DataFrame, key: str = "image_id") -> DataFrame:
    """Parameters of over where they are given, else those of base."""
    o = over.select(key, *(F.col(c).alias(f"__{c}") for c in over.columns if c != key))
    return base.join(o, key, "left").select(key, *(F.coalesce(f"__{c}", c).alias(c) if c in over.columns else F.col(c) for c in base.columns if c != key))
