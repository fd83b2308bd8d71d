"""Rounding and storage rules of 8-bit rasters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str


def col(v: Value) -> Column:
    return F.col(v) if isinstance(v, str) else v


def half_up(v: Value) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(col(v) + F.lit(0.5)).cast("int")


def store_u8(v: Value) -> Column:
    """As a clamped byte array stores a number: halves to even, 0 to 255."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround(col(v).cast("double")))).cast("int")


def blend_u8(s: Value, a: Value, back: Column | int) -> Column:
    """Truncating blend of a byte s of alpha a on a background byte."""
    back = F.lit(back) if isinstance(back, int) else back
    return F.floor((col(s) * col(a) + back * (255 - col(a)) + 127) / 255).cast("int")


def premultiplied(c: Value, a: Value) -> Column:
    return store_u8((col(c) * col(a) + 127) / F.lit(255.0))


def unpremultiplied(c: Value, a: Value) -> Column:
    return F.when(col(a) == 0, 0).otherwise(store_u8(col(c) * F.lit(255.0) / F.when(col(a) != 0, col(a))))


def colour_key(r: Value = "r", g: Value = "g", b: Value = "b") -> Column:
    """Five bits of each channel."""
    return F.shiftright(col(r), 3) * 1024 + F.shiftright(col(g), 3) * 32 + F.shiftright(col(b), 3)


def packed_rgba(r: Value = "r", g: Value = "g", b: Value = "b", a: Value = "a") -> Column:
    return (col(r).cast("long") * 16777216 + col(g) * 65536 + col(b) * 256 + col(a)).cast("long")


def hex_colour(r: Value = "r", g: Value = "g", b: Value = "b") -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(col(c)), 2, "0")) for c in (r, g, b)))


# Weights of the channels in a colour distance.
WEIGHTS = (0.5054, 0.9925, 0.4342)


def weighted_distance2(a: tuple, b: tuple) -> Column:
    """Squared distance of two colours given as three columns or numbers each."""
    parts = [(F.lit(w) * (x - y)) for w, x, y in zip(WEIGHTS, a, b)]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def luma(r: Value = "r", g: Value = "g", b: Value = "b") -> Column:
    return (F.lit(0.299) * col(r) + F.lit(0.587) * col(g) + F.lit(0.114) * col(b)).cast("float")


def fnv1a(s: Value) -> Column:
    """32-bit FNV-1a of the UTF-16 units of a string; for text of the basic plane these are its code points."""
    units = F.transform(F.split(col(s), ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(16777619), F.lit(4294967296))
    return F.aggregate(F.filter(units, lambda u: u.isNotNull()), F.lit(2166136261).cast("long"), step)


def parity(x: Value, y: Value, cell: Column, ox: Column, oy: Column) -> Column:
    """Colour of a checkerboard's cell at a pixel's centre."""
    k = F.floor((col(x) + 0.5 - ox) / cell) + F.floor((col(y) + 0.5 - oy) / cell)
    return F.pmod(k, F.lit(2)).cast("int")
