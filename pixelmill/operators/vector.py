"""Path segments, gradients and coverage as relations.

path_segs: image_id, layer, path, seq, kind (M, L, Q, C or Z) and the points x1, y1, x2, y2, x, y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_stats(segs: DataFrame) -> DataFrame:
    """Paths, nodes (ends of L, Q and C), corners, curves and the share of corners."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    s = segs.groupBy("image_id").agg(n("M").alias("paths"), n("L", "Q", "C").alias("nodes"), n("L").alias("corners"), n("Q", "C").alias("curves"))
    return s.withColumn("corner_share", F.when(F.col("nodes") > 0, F.col("corners") / F.col("nodes")).otherwise(0.0))


def path_bounds(segs: DataFrame) -> DataFrame:
    """Bounds of all end and control points."""
    points = segs.where("kind <> 'Z'").select("image_id", F.expr("stack(3, x1, y1, x2, y2, x, y) AS (px, py)")).where("px IS NOT NULL")
    return points.groupBy("image_id").agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))


def repeated_commands(segs: DataFrame) -> DataFrame:
    """Whether a segment's command is that of the one before, so that its letter may be left out."""
    before = F.lag("kind").over(Window.partitionBy("image_id", "path").orderBy("seq"))
    return segs.withColumn("implicit", F.coalesce((before == F.col("kind")) & ~F.col("kind").isin("M", "Z"), F.lit(False)))


def relative_moves(rects: DataFrame) -> DataFrame:
    """Move of each rectangle from the one of the same colour before it."""
    w = Window.partitionBy("image_id", "colour").orderBy("seq")
    return rects.withColumn("dx", F.col("x") - F.coalesce(F.lag("x").over(w), F.lit(0))).withColumn("dy", F.col("y") - F.coalesce(F.lag("y").over(w), F.lit(0)))


def rect_paths(rects: DataFrame) -> DataFrame:
    """Path data of each colour: one move and box a rectangle, moves relative to the last of the colour."""
    part = F.concat(F.lit("m"), F.col("dx"), F.lit(" "), F.col("dy"), F.lit("h"), F.col("w"), F.lit("v"), F.col("h"), F.lit("h-"), F.col("w"), F.lit("z"))
    rows = relative_moves(rects).select("image_id", "colour", "seq", part.alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda s: s["part"]), "")
    return rows.groupBy("image_id", "colour").agg(F.count("*").alias("rects"), joined.alias("d"))


def gradient_t(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Place along a linear gradient, 0 to 1; 1 if it has no length."""
    dx, dy = x2 - x1, y2 - y1
    dd = dx * dx + dy * dy
    return F.when(dd > 0, F.nanvl(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * dx + (y - y1) * dy) / F.when(dd > 0, dd))), F.lit(0.0))).otherwise(1.0)


def radial_t(x: Column, y: Column, cx: Column, cy: Column, r: Column) -> Column:
    return F.when(r > 0, F.least(F.lit(1.0), F.hypot(x - cx, y - cy) / F.when(r > 0, r))).otherwise(1.0)


def stop_colour(t: Column, stops: Column, channel: str) -> Column:
    """Channel at t between stops (offset, r, g, b) in order; of stops at one offset the last counts; black without any."""
    before = F.element_at(F.filter(stops, lambda s: s["offset"] <= t), -1)
    after = F.filter(stops, lambda s: s["offset"] > t)
    some = F.size(F.filter(stops, lambda s: s["offset"] <= t)) > 0
    first, nxt = F.get(stops, F.lit(0)), F.get(after, F.lit(0))
    mixed = before[channel] + (nxt[channel] - before[channel]) * (t - before["offset"]) / (nxt["offset"] - before["offset"])
    return F.when(F.size(stops) == 0, 0.0).when(~some, first[channel]).when(F.size(after) == 0, before[channel]).otherwise(mixed)


def mean_colour(stops: Column, channel: str) -> Column:
    """Mean over 0..1: constant to the first and from the last stop, trapezoids between."""
    n = F.size(stops)
    pairs = F.zip_with(F.slice(stops, 1, n - 1), F.slice(stops, 2, n - 1), lambda p, q: (q["offset"] - p["offset"]) * (p[channel] + q[channel]) / 2)
    inner = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)
    return F.when(n == 0, 0.0).otherwise(F.get(stops, F.lit(0))[channel] * F.get(stops, F.lit(0))["offset"] + inner + F.get(stops, n - 1)[channel] * (1 - F.get(stops, n - 1)["offset"]))


def degenerate_radial(r: Column, stops: Column) -> Column:
    """The same for a radial gradient: its radius is its length."""
    return degenerate(F.lit(0.0), F.lit(0.0), r, F.lit(0.0), stops) | (r < 0)


def degenerate(x1: Column, y1: Column, x2: Column, y2: Column, stops: Column) -> Column:
    """No gradient to speak of: fewer than two stops, no length, or stops within a level of one another."""
    span = lambda k: F.array_max(F.transform(stops, lambda s: s[k])) - F.array_min(F.transform(stops, lambda s: s[k]))
    length = F.hypot(x2 - x1, y2 - y1)
    return (F.size(stops) < 2) | F.isnan(length) | (length < 1e-6) | ((span("r") <= 1) & (span("g") <= 1) & (span("b") <= 1))


def normalised_stops(stops: Column) -> Column:
    """Offsets within 0..1 that never fall; of three or more stops at one offset the first and the last."""
    clipped = F.transform(stops, lambda s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), s["offset"])))
    rising = F.transform(stops, lambda s, i: F.struct(F.array_max(F.slice(clipped, 1, i + 1)).alias("offset"), s["r"].alias("r"), s["g"].alias("g"), s["b"].alias("b")))

    def ends(s: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(F.get(rising, j)["offset"] == s["offset"], F.lit(False))
        return ~(same(i - 1) & same(i + 1))

    return F.filter(rising, ends)


def coverage(edges: DataFrame, ss: int = 4) -> DataFrame:
    """Coverage of pixels by the polygons of an image under the nonzero rule: ss sample rows a pixel, exact along x.

    edges: image_id, x1, y1, x2, y2. An edge is on the sample rows from its upper end up to, not at, its lower end. Each
    row's crossings give spans by their running winding number, and spans are dealt to the pixels that they meet.
    """
    down = F.col("y2") > F.col("y1")
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(top * ss - 0.5), F.ceil(bottom * ss - 0.5) - 1
    rows = edges.where("y1 <> y2").select("image_id", "x1", "y1", "x2", "y2", F.when(down, 1).otherwise(-1).alias("turn"), first.alias("a"), last.alias("b")).where("a <= b")
    rows = rows.withColumn("j", F.explode(F.sequence("a", "b")))
    at = (F.col("j") + 0.5) / ss
    x = F.col("x1") + (at - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    line = Window.partitionBy("image_id", "j").orderBy("cx", "turn")
    crossings = rows.select("image_id", "j", x.alias("cx"), "turn")
    spans = crossings.withColumn("winding", F.sum("turn").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("cx").over(line)).where("winding <> 0 AND to > cx")
    cells = spans.withColumn("x", F.explode(F.sequence(F.floor("cx"), F.ceil("to") - 1)))
    part = F.least(F.col("to"), F.col("x") + 1.0) - F.greatest(F.col("cx"), F.col("x").cast("double"))
    return cells.groupBy("image_id", F.floor(F.col("j") / ss).alias("y"), "x").agg((F.sum(part) / ss).alias("coverage"))


def svg_document(paths: DataFrame) -> DataFrame:
    """svg of each image from its layers (image_id, rank, d, fill, width, height) in order; empty paths are left out."""
    many = F.length(F.regexp_replace("d", "[^Mm]", "")) > 1
    element = F.concat(F.lit('  <path fill="'), "fill", F.lit('"'), F.when(many, F.lit(' fill-rule="evenodd"')).otherwise(""), F.lit(' d="'), "d", F.lit('"/>'))
    kept = paths.where(F.length("d") > 0).select("image_id", "rank", element.alias("e"), "width", "height")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "e"))), lambda s: s["e"]), "\n")
    head = lambda w, h: F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), w, F.lit(" "), h, F.lit('" width="'), w, F.lit('" height="'), h, F.lit('">\n'))
    return kept.groupBy("image_id").agg(body.alias("body"), F.max("width").alias("w"), F.max("height").alias("h")).select("image_id", F.concat(head(F.col("w"), F.col("h")), "body", F.lit("\n</svg>\n")).alias("svg"))


def escape_xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s
