"""Kinds of image files, size limits, names and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST_SIDE = 4096


def sniff_kind(content: Column) -> Column:
    """png, jpeg, gif, bmp or webp by the first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    starts = lambda s: head.startswith(F.lit(s))
    # The first bytes of each format.
    return (
        F.when(starts("89504E470D0A1A0A"), "png").when(starts("FFD8FF"), "jpeg").when(starts("474946383761") | starts("474946383961"), "gif")
        .when(starts("424D"), "bmp").when(starts("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )


def extension(name: Column) -> Column:
    """Upper-case extension of a file name, or empty."""
    return F.upper(F.regexp_extract(F.lower(name), r"\.([a-z0-9]{1,8})$", 1))


def dimension_error(width: Column, height: Column) -> Column:
    """Why an image of this size isn't taken, or null."""
    return F.when((width <= 0) | (height <= 0), "empty").when((width > LARGEST_SIDE) | (height > LARGEST_SIDE), "too large")


def valid_buffer(data: Column, width: Column, height: Column) -> Column:
    return F.octet_length(data) == width * height * 4


def utf8_length(s: Column) -> Column:
    return F.octet_length(F.encode(s, "UTF-8"))


def svg_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,8}$", ""), F.lit(".svg"))


def data_url(svg: Column) -> Column:
    return F.concat(F.lit("data:image/svg+xml;charset=utf-8,"), F.replace(F.url_encode(svg), F.lit("+"), F.lit("%20")))


def fidelity_level(v: Column) -> Column:
    return F.when(v >= 0.97, "ok").when(v >= 0.9, "warn").otherwise("bad")
