"""Queries over the derived rasters, each with SQL that says the same in another way.

The SQL looks neighbours up by their coordinates and spells sums out; the operators use windows and arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import colour as col_ops
from ..operators import histogram as hist_ops
from ..operators import masks, metrics, pointwise, resample, stencil, vector
from ..sources import tables
from ..sources.tables import COLOUR_SQL, DENSITY_SQL, GRAY_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PALETTE = [(20, 30, 40), (200, 60, 90), (90, 180, 30), (240, 240, 200)]


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(c, digits: int = 6):
    """Doubles are compared to some digits, as the order of a sum isn't defined."""
    return F.round(c, digits)


def gray(spark, sf_dir):
    return tables.gray(spark, sf_dir)


def colour(spark, sf_dir):
    return tables.colour(spark, sf_dir)


def shifted(g: DataFrame) -> DataFrame:
    """Each image moved up by a row, its first row again below."""
    height = F.max("y").over(Window.partitionBy("image_id")) + 1
    return g.withColumn("height", height).withColumn("y", F.pmod(F.col("y") - 1, F.col("height"))).drop("height")


# SQL of shared parts

HIST = f"WITH {GRAY_SQL}, hist AS (SELECT image_id, v, count(*) AS n FROM gray GROUP BY ALL)"
SPLIT = """cum AS (
  SELECT a.image_id, a.v, lead(a.v) OVER (PARTITION BY a.image_id ORDER BY a.v) AS up,
         (SELECT CAST(sum(b.n) AS DOUBLE) FROM hist b WHERE b.image_id = a.image_id AND b.v <= a.v) AS w0,
         (SELECT CAST(sum(b.n * b.v) AS DOUBLE) FROM hist b WHERE b.image_id = a.image_id AND b.v <= a.v) AS s0,
         (SELECT CAST(sum(b.n) AS DOUBLE) FROM hist b WHERE b.image_id = a.image_id) AS w,
         (SELECT CAST(sum(b.n * b.v) AS DOUBLE) FROM hist b WHERE b.image_id = a.image_id) AS s
  FROM hist a),
split AS (
  SELECT image_id, v + 1 AS lo, up AS hi,
         w0 / w * ((w - w0) / w) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) AS between
  FROM cum WHERE up IS NOT NULL),
otsu AS (
  SELECT i.image_id, coalesce(min((b.lo2 + b.hi2 + 1) // 2), 128) AS t, coalesce(max(b.top), 0) AS between
  FROM (SELECT DISTINCT image_id FROM hist) i LEFT JOIN (
    SELECT image_id, min(lo) AS lo2, max(hi) AS hi2, max(between) AS top FROM split s
    WHERE between = (SELECT max(between) FROM split z WHERE z.image_id = s.image_id) GROUP BY image_id) b USING (image_id)
  GROUP BY i.image_id)"""


def around_sql(source: str, columns: list[str], border: str = "nearest", name: str = "around") -> str:
    """The 3 x 3 pixels around each, by their coordinates; border: nearest or none."""
    joins, picks = [], []
    for i, (dy, dx) in enumerate(stencil.AROUND):
        if border == "nearest":
            on = f"n{i}.image_id = p.image_id AND n{i}.y = least(greatest(p.y + ({dy}), 0), d.h) AND n{i}.x = least(greatest(p.x + ({dx}), 0), d.w)"
        else:
            on = f"n{i}.image_id = p.image_id AND n{i}.y = p.y + ({dy}) AND n{i}.x = p.x + ({dx})"
        joins.append(f"LEFT JOIN {source} n{i} ON {on}")
        picks += [f"n{i}.{c} AS {c}_{i}" for c in columns]
    return f"{name} AS (SELECT p.*, d.w, d.h, {', '.join(picks)} FROM {source} p JOIN (SELECT image_id, max(x) AS w, max(y) AS h FROM {source} GROUP BY image_id) d USING (image_id) {' '.join(joins)})"


def sobel_sql(c: str) -> tuple[str, str]:
    gx = f"(({c}_2 + 2 * {c}_5 + {c}_8 - {c}_0 - 2 * {c}_3 - {c}_6) / 4e0)"
    gy = f"(({c}_6 + 2 * {c}_7 + {c}_8 - {c}_0 - 2 * {c}_1 - {c}_2) / 4e0)"
    return gx, gy


def magnitude_sql(c: str) -> str:
    gx, gy = sobel_sql(c)
    return f"sqrt({gx} * {gx} + {gy} * {gy})"


def laplacian_sql(c: str) -> str:
    return f"(abs({' + '.join(f'{c}_{i}' for i in range(9))} - 9 * {c}_4) / 8e0)"


def distance_sql(p, cols="rgb") -> str:
    return " + ".join(f"({w}e0 * ({c} - {v})) * ({w}e0 * ({c} - {v}))" for w, c, v in zip(numeric.WEIGHTS, cols, p))


def nearest_sql(source: str) -> str:
    rows = " UNION ALL ".join(f"SELECT s.*, {j} AS label, {distance_sql(p)} AS d2 FROM {source} s" for j, p in enumerate(PALETTE))
    return f"cand AS ({rows}), nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY d2, label) AS k FROM cand) WHERE k = 1)"


KEY_SQL = "(r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3)"
INK = "ink AS (SELECT g.image_id, y, x, CAST(v < t AS INTEGER) AS m FROM gray g JOIN otsu USING (image_id))"


def ink(spark, sf_dir):
    """Ink at each image's own threshold."""
    g = gray(spark, sf_dir)
    t = hist_ops.otsu(hist_ops.histogram256(g)).select("image_id", "t")
    return pointwise.binarise(g.join(t, "image_id"), F.col("t") / F.lit(255.0)).select("image_id", "y", "x", "m")


# Histograms and thresholds


@query(HIST + " SELECT image_id, v, n FROM hist")
def hist256_by_image(spark, sf_dir):
    return hist_ops.histogram256(gray(spark, sf_dir))


@query(f"{HIST}, {SPLIT} SELECT image_id, CAST(t AS INTEGER) AS t, round(between, 6) AS variance FROM otsu")
def otsu_by_image(spark, sf_dir):
    return hist_ops.otsu(hist_ops.histogram256(gray(spark, sf_dir))).select("image_id", "t", r("between").alias("variance"))


PERCENTILE = """ink AS (SELECT image_id, min(v) AS ink FROM (SELECT h.image_id, v, sum(n) OVER (PARTITION BY h.image_id ORDER BY v) AS c, sum(n) OVER (PARTITION BY h.image_id) AS tot FROM hist h JOIN otsu USING (image_id) WHERE v < t) WHERE c >= 0.05e0 * tot GROUP BY image_id),
paper AS (SELECT image_id, min(v) AS paper FROM (SELECT h.image_id, v, sum(n) OVER (PARTITION BY h.image_id ORDER BY v) AS c, sum(n) OVER (PARTITION BY h.image_id) AS tot FROM hist h JOIN otsu USING (image_id) WHERE v >= t) WHERE c >= 0.5e0 * tot GROUP BY image_id)"""


@query(f"""{HIST}, {SPLIT}, {PERCENTILE}
SELECT image_id, CAST(t AS INTEGER) AS t, CAST(ink AS INTEGER) AS ink, CAST(paper AS INTEGER) AS paper,
  round(least(0.98e0, greatest(0.02e0, CASE WHEN abs(paper - ink) >= 24 THEN (ink + paper) / 510e0 ELSE least(0.65e0, greatest(0.35e0, t / 255e0)) END)), 6) AS threshold
FROM otsu LEFT JOIN ink USING (image_id) LEFT JOIN paper USING (image_id)""")
def iso_threshold(spark, sf_dir):
    return hist_ops.iso_threshold(gray(spark, sf_dir)).withColumn("threshold", r("threshold"))


@query(f"""{HIST} SELECT image_id, CAST(max(v) FILTER (WHERE c >= 0.05e0 * tot) AS INTEGER) AS v FROM (
  SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v DESC) AS c, sum(n) OVER (PARTITION BY image_id) AS tot FROM hist) GROUP BY image_id""")
def class_percentile_from_top(spark, sf_dir):
    return hist_ops.class_percentile(hist_ops.histogram256(gray(spark, sf_dir)), 0, 255, 0.05, True)


@query(f"""{HIST}, {SPLIT}, px AS (SELECT g.image_id, CAST(v AS DOUBLE) AS v, v < t AS low, between FROM gray g JOIN otsu USING (image_id))
SELECT image_id, round(max(between) / var_pop(v), 6) AS separability,
  max(between) / var_pop(v) >= 0.6e0 AND sqrt(greatest(var_pop(v) FILTER (WHERE low), var_pop(v) FILTER (WHERE NOT low))) <= 0.25e0 * (avg(v) FILTER (WHERE NOT low) - avg(v) FILTER (WHERE low)) AS bimodal
FROM px GROUP BY image_id""")
def bimodality(spark, sf_dir):
    return hist_ops.bimodality(hist_ops.histogram256(gray(spark, sf_dir))).withColumn("separability", r("separability"))


@query(f"""{HIST}, spine AS (SELECT image_id, CAST(s AS INTEGER) AS v FROM (SELECT DISTINCT image_id FROM hist), generate_series(0, 255) t(s)),
dense AS (SELECT s.image_id, s.v, coalesce(n, 0) AS n FROM spine s LEFT JOIN hist USING (image_id, v)),
c AS (SELECT a.image_id, a.v, sum(b.n) AS c FROM dense a JOIN dense b ON a.image_id = b.image_id AND b.v BETWEEN a.v - 3 AND a.v + 3 GROUP BY ALL),
f AS (SELECT image_id, v AS p0 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c DESC, v) AS k FROM c) WHERE k = 1),
m AS (SELECT c.image_id, c.v, c.c FROM c JOIN f USING (image_id) WHERE abs(c.v - p0) >= 8 AND c.c > 0
  AND c.c >= coalesce((SELECT z.c FROM c z WHERE z.image_id = c.image_id AND z.v = c.v - 1), -1) AND c.c >= coalesce((SELECT z.c FROM c z WHERE z.image_id = c.image_id AND z.v = c.v + 1), -1))
SELECT f.image_id, p0, CAST((SELECT min(v) FROM m WHERE m.image_id = f.image_id AND m.c = (SELECT max(z.c) FROM m z WHERE z.image_id = f.image_id)) AS INTEGER) AS p1 FROM f""")
def two_peaks(spark, sf_dir):
    return hist_ops.two_peaks(hist_ops.histogram256(gray(spark, sf_dir)))


@query(f"WITH {GRAY_SQL} SELECT image_id, round(quantile_cont(CAST(v AS DOUBLE), 0.005), 6) AS lo, round(quantile_cont(CAST(v AS DOUBLE), 0.995), 6) AS hi FROM gray GROUP BY image_id")
def quantile_pair(spark, sf_dir):
    return hist_ops.quantile_pair(gray(spark, sf_dir), 0.005, 0.995).select("image_id", r("lo").alias("lo"), r("hi").alias("hi"))


# Ink


@query(f"""{HIST}, {SPLIT}, {INK}, eroded AS (SELECT i.image_id, i.y, i.x FROM ink i WHERE m = 1 AND (SELECT count(*) FROM ink z WHERE z.image_id = i.image_id AND z.m = 1 AND abs(z.y - i.y) + abs(z.x - i.x) = 1) = 4)
SELECT i.image_id, CAST(t AS INTEGER) AS t, CAST(sum(m) AS BIGINT) AS ink, coalesce(e.core, 0) AS core,
  round(CASE WHEN sum(m) > 0 THEN 1 - coalesce(e.core, 0) / sum(m) ELSE 0 END, 6) AS thin
FROM ink i JOIN otsu USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS core FROM eroded GROUP BY ALL) e USING (image_id) GROUP BY i.image_id, t, e.core""")
def binarised_ink(spark, sf_dir):
    g = gray(spark, sf_dir)
    t = hist_ops.otsu(hist_ops.histogram256(g)).select("image_id", "t")
    mask = pointwise.binarise(g.join(t, "image_id"), F.col("t") / F.lit(255.0)).select("image_id", "y", "x", "m")
    thin = stencil.thin_stroke_share(mask)
    return thin.join(t, "image_id").select("image_id", "t", F.col("ink").cast("long"), F.col("core").cast("long"), r("thin").alias("thin"))


@query(f"{HIST}, {SPLIT}, {INK} SELECT image_id, CAST(sum(m) AS BIGINT) AS ink, max(m) = 1 AS has_ink FROM ink GROUP BY image_id")
def ink_count(spark, sf_dir):
    return masks.ink_count(ink(spark, sf_dir))


@query(f"""{HIST}, {SPLIT}, {INK}, grown AS (SELECT DISTINCT i.image_id, i.y + dy AS y, i.x + dx AS x FROM ink i, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dy, dx) WHERE m = 1)
SELECT g.image_id, count(*) AS grown FROM grown g JOIN ink i ON i.image_id = g.image_id AND i.y = g.y AND i.x = g.x GROUP BY g.image_id""")
def dilated_ink(spark, sf_dir):
    d = stencil.dilate1(ink(spark, sf_dir)).groupBy("image_id").agg(F.sum("m").cast("long").alias("grown"))
    return d.where("grown > 0")


@query(f"""{HIST}, {SPLIT}, {INK} SELECT a.image_id, round(count(*) FILTER (WHERE a.m <> b.m) * pi() / 4, 6) AS perimeter
FROM ink a JOIN ink b ON a.image_id = b.image_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.y = a.y + 1 AND b.x = a.x)) GROUP BY a.image_id""")
def perimeter(spark, sf_dir):
    return stencil.perimeter(ink(spark, sf_dir)).withColumn("perimeter", r("perimeter"))


@query(f"""WITH {GRAY_SQL}, s AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, min(x) FILTER (WHERE abs(v - 127) > 100) AS ax, max(x) FILTER (WHERE abs(v - 127) > 100) AS bx, min(y) FILTER (WHERE abs(v - 127) > 100) AS ay, max(y) FILTER (WHERE abs(v - 127) > 100) AS by_ FROM gray GROUP BY image_id),
p AS (SELECT *, CAST(floor(0.05e0 * greatest(w, h) + 0.5e0) AS INTEGER) AS pad FROM s)
SELECT image_id, CASE WHEN ax IS NULL THEN 0 ELSE greatest(0, ax - pad) END AS x0, CASE WHEN ay IS NULL THEN 0 ELSE greatest(0, ay - pad) END AS y0, CASE WHEN bx IS NULL THEN w ELSE least(w, bx + 1 + pad) END AS x1, CASE WHEN by_ IS NULL THEN h ELSE least(h, by_ + 1 + pad) END AS y1 FROM p""")
def ink_box(spark, sf_dir):
    return masks.ink_box(gray(spark, sf_dir), 127, 100)


# Pixels


@query(f"WITH {COLOUR_SQL} SELECT image_id, y, x, CAST(round(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 3) AS DOUBLE) AS v FROM colour")
def luma(spark, sf_dir):
    return pointwise.to_gray(colour(spark, sf_dir)).withColumn("v", r(F.col("v").cast("double"), 3))


@query(f"""WITH {COLOUR_SQL} SELECT image_id, y, x, {', '.join(f"CASE WHEN a = 255 THEN {c} WHEN a = 0 THEN {k} ELSE CAST(({c} * a + {k} * (255 - a) + 127) // 255 AS INTEGER) END AS {c}" for c, k in zip('rgb', (250, 128, 3)))}, 255 AS a FROM colour""")
def composite_on_colour(spark, sf_dir):
    return pointwise.composite_on_colour(colour(spark, sf_dir), (250, 128, 3))


@query(f"""WITH {COLOUR_SQL}, pre AS (SELECT image_id, y, x, a, {', '.join(f'CAST(least(255, round_even(({c} * a + 127) / 255e0, 0)) AS INTEGER) AS {c}' for c in 'rgb')} FROM colour)
SELECT image_id, y, x, {', '.join(f'CASE WHEN a = 0 THEN 0 ELSE CAST(least(255, round_even({c} * 255e0 / a, 0)) AS INTEGER) END AS {c}' for c in 'rgb')}, a FROM pre""")
def premultiply_roundtrip(spark, sf_dir):
    return pointwise.unpremultiply(pointwise.premultiply(colour(spark, sf_dir)))


@query(f"WITH {COLOUR_SQL} SELECT image_id, round(avg(CAST(a < 8 AS INTEGER)), 9) AS transparent, round(avg(CAST(a BETWEEN 8 AND 247 AS INTEGER)), 9) AS partial FROM colour GROUP BY image_id")
def alpha_shares(spark, sf_dir):
    return hist_ops.alpha_shares(colour(spark, sf_dir)).select("image_id", r("transparent", 9).alias("transparent"), r("partial", 9).alias("partial"))


@query(f"WITH {COLOUR_SQL} SELECT image_id, CAST(sum(CAST(a >= 127.5e0 AS INTEGER)) AS BIGINT) AS ink FROM colour GROUP BY image_id")
def mask_from_alpha(spark, sf_dir):
    return pointwise.mask_from_alpha(colour(spark, sf_dir)).groupBy("image_id").agg(F.sum("m").cast("long").alias("ink"))


@query(f"WITH {COLOUR_SQL} SELECT image_id, count(DISTINCT (r, g, b, a)) = 1 AS uniform, count(DISTINCT a) = 1 AS alpha_uniform, bool_and(a = 255) AS \"full\" FROM colour GROUP BY image_id")
def uniformity(spark, sf_dir):
    return pointwise.uniformity(colour(spark, sf_dir))


@query(f"WITH {COLOUR_SQL}, s AS (SELECT image_id, count(*) AS n FROM colour GROUP BY image_id) SELECT image_id, y, x, r, g, b, a FROM colour JOIN s USING (image_id) WHERE (y * 32 + x) % greatest(1, n // 100) = 0 AND a >= 128")
def stride_sample(spark, sf_dir):
    return pointwise.stride_sample(colour(spark, sf_dir), 100)


@query(f"WITH {COLOUR_SQL}, s AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM colour GROUP BY image_id) SELECT image_id, count(*) AS n, CAST(sum(r) AS BIGINT) AS total FROM colour JOIN s USING (image_id) WHERE x < 3 OR y < 3 OR x >= w - 3 OR y >= h - 3 GROUP BY image_id")
def border_band(spark, sf_dir):
    c = colour(spark, sf_dir)
    rows = pointwise.border_band(c.join(pointwise.sizes(c).drop("n"), "image_id"), F.col("width"), F.col("height"))
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("r").cast("long").alias("total"))


@query(f"""WITH {COLOUR_SQL}, l AS (SELECT image_id, greatest(r, g, b) - least(r, g, b) <= 60 AS neutral, CAST(0.299e0 * r + 0.587e0 * g + 0.114e0 * b AS REAL) AS v FROM colour)
SELECT image_id, count(*) FILTER (WHERE neutral AND abs(v - 90) <= 30) AS zeros, count(*) FILTER (WHERE neutral AND abs(v - 90) > 30 AND abs(v - 170) <= 30) AS ones FROM l GROUP BY image_id""")
def level_predicate(spark, sf_dir):
    rows = pointwise.level_at(colour(spark, sf_dir), 90, 170, 60, 30)
    return rows.groupBy("image_id").agg(F.count_if(F.col("level") == 0).alias("zeros"), F.count_if(F.col("level") == 1).alias("ones"))


@query(f"WITH {GRAY_SQL} SELECT image_id, y // 4 AS y, x // 4 AS x, v FROM gray WHERE x % 4 = 0 AND y % 4 = 0")
def downscale_nearest(spark, sf_dir):
    return pointwise.downscale_nearest(gray(spark, sf_dir), 4)


@query(f"WITH {GRAY_SQL} SELECT image_id, CAST(y * 3 + dy AS INTEGER) AS y, CAST(x * 3 + dx AS INTEGER) AS x, v FROM gray, generate_series(0, 2) a(dy), generate_series(0, 2) b(dx)")
def upscale_nearest(spark, sf_dir):
    return pointwise.upscale_nearest(gray(spark, sf_dir), 3)


@query(f"WITH {COLOUR_SQL}, {nearest_sql('colour')} SELECT image_id, CASE WHEN a < 128 THEN 0 ELSE label END AS label, count(*) AS n FROM nearest GROUP BY ALL")
def assign_labels(spark, sf_dir):
    return pointwise.assign_labels(colour(spark, sf_dir), PALETTE).groupBy("image_id", "label").agg(F.count("*").alias("n"))


RAMP = """CASE WHEN m <= 16 THEN 0 WHEN m / 255e0 < 0.3e0 THEN {0} WHEN m / 255e0 >= 0.6e0 THEN {2}
  WHEN m / 255e0 < 0.45e0 THEN CAST(round_even({0} + ({1} - {0}) * (m / 255e0 - 0.3e0) / 0.15e0, 0) AS INTEGER)
  ELSE CAST(round_even({1} + ({2} - {1}) * (m / 255e0 - 0.45e0) / 0.15e0, 0) AS INTEGER) END"""


@query(f"""WITH {COLOUR_SQL}, d AS (SELECT p.image_id, p.y, p.x, greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) AS m FROM colour p JOIN colour q ON q.image_id = p.image_id AND q.y = p.y AND q.x = (p.x + 1) % 32)
SELECT image_id, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum(a) AS BIGINT) AS a FROM (
  SELECT image_id, {RAMP.format(255, 255, 224)} AS r, {RAMP.format(214, 122, 24)} AS g, {RAMP.format(0, 0, 24)} AS b, CASE WHEN m <= 16 THEN 0 ELSE least(255, 3 * m) END AS a FROM d) GROUP BY image_id""")
def diff_heatmap(spark, sf_dir):
    c = colour(spark, sf_dir)
    moved = c.withColumn("x", F.pmod(F.col("x") + F.lit(31), F.lit(32)))
    return pointwise.diff_heatmap(c, moved).groupBy("image_id").agg(*(F.sum(k).cast("long").alias(k) for k in "rgba"))


# Colours


@query(f"WITH {COLOUR_SQL} SELECT image_id, {KEY_SQL} AS key, count(*) AS n, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(b) AS BIGINT) AS sb FROM colour WHERE a >= 128 GROUP BY ALL")
def colour_histogram_5bit(spark, sf_dir):
    return col_ops.colour_histogram(colour(spark, sf_dir))


@query(f"WITH {COLOUR_SQL}, h AS (SELECT image_id, {KEY_SQL} AS key, count(*) AS n FROM colour WHERE a >= 128 GROUP BY ALL) SELECT image_id, count(*) AS colours FROM h WHERE n >= 0.003e0 * (SELECT sum(z.n) FROM h z WHERE z.image_id = h.image_id) GROUP BY image_id")
def distinct_colours(spark, sf_dir):
    return col_ops.distinct_colours(colour(spark, sf_dir), 0.003)


MODE = """top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, key) AS k, sum(n) OVER (PARTITION BY image_id) AS tot FROM h)"""
MEANS = ", ".join(f"CAST(floor(s{c} / n + 0.5e0) AS INTEGER) AS {c}" for c in "rgb")


@query(f"""WITH {COLOUR_SQL}, s AS (SELECT image_id, max(x) AS w, max(y) AS hh FROM colour GROUP BY image_id),
h AS (SELECT image_id, {KEY_SQL} AS key, count(*) AS n, CAST(sum(r) AS DOUBLE) AS sr, CAST(sum(g) AS DOUBLE) AS sg, CAST(sum(b) AS DOUBLE) AS sb FROM colour JOIN s USING (image_id) WHERE a >= 128 AND (x = 0 OR y = 0 OR x = w OR y = hh) GROUP BY ALL), {MODE}
SELECT image_id, {MEANS} FROM top WHERE k = 1 AND n / tot >= 0.01e0""")
def border_mode_colour(spark, sf_dir):
    return col_ops.border_mode_colour(colour(spark, sf_dir), 0.01)


@query(f"""WITH {COLOUR_SQL}, h AS (SELECT image_id, {KEY_SQL} AS key, count(*) AS n, CAST(sum(r) AS DOUBLE) AS sr, CAST(sum(g) AS DOUBLE) AS sg, CAST(sum(b) AS DOUBLE) AS sb FROM colour
  WHERE a >= 128 AND (r - 255) * (r - 255) + (g - 255) * (g - 255) + (b - 255) * (b - 255) > 2304 GROUP BY ALL), {MODE}
SELECT image_id, {MEANS} FROM top WHERE k = 1""")
def dominant_ink(spark, sf_dir):
    return col_ops.dominant_ink_colour(colour(spark, sf_dir), (255, 255, 255))


@query(f"WITH {COLOUR_SQL}, opaque AS (SELECT * FROM colour WHERE a >= 128), {nearest_sql('opaque')} SELECT image_id, round(avg(CAST(d2 > 576 AS INTEGER)), 6) AS off_share, round(avg(sqrt(d2)), 6) AS error FROM nearest GROUP BY image_id")
def off_palette_share(spark, sf_dir):
    return col_ops.off_palette_share(colour(spark, sf_dir), PALETTE).select("image_id", r("off_share").alias("off_share"), r("error").alias("error"))


def kmeans_sql(rounds: int) -> str:
    parts = [COLOUR_SQL, "px AS (SELECT image_id, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, y, x FROM colour WHERE a >= 128)"]
    start = " UNION ALL ".join(f"SELECT image_id, {j} AS label, {p[0]}e0 AS r, {p[1]}e0 AS g, {p[2]}e0 AS b FROM (SELECT DISTINCT image_id FROM px)" for j, p in enumerate(PALETTE))
    parts.append(f"c0 AS ({start})")
    d2 = " + ".join(f"({w}e0 * (p.{c} - c.{c})) * ({w}e0 * (p.{c} - c.{c}))" for w, c in zip(numeric.WEIGHTS, "rgb"))
    for i in range(rounds):
        parts.append(f"a{i} AS (SELECT * FROM (SELECT p.image_id, p.r, p.g, p.b, c.label, row_number() OVER (PARTITION BY p.image_id, p.y, p.x ORDER BY {d2}, c.label) AS k FROM px p JOIN c{i} c USING (image_id)) WHERE k = 1)")
        parts.append(f"c{i + 1} AS (SELECT c.image_id, c.label, coalesce(m.r, c.r) AS r, coalesce(m.g, c.g) AS g, coalesce(m.b, c.b) AS b FROM c{i} c LEFT JOIN (SELECT image_id, label, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM a{i} GROUP BY ALL) m USING (image_id, label))")
    return f"WITH {', '.join(parts)} SELECT image_id, label, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM c{rounds}"


@query(kmeans_sql(3))
def kmeans_3_rounds(spark, sf_dir):
    out = col_ops.kmeans_refine(colour(spark, sf_dir), PALETTE, 3)
    return out.select("image_id", "label", *(r(c).alias(c) for c in "rgb"))


# Stencils


@query(f"WITH {GRAY_SQL}, {around_sql('gray', ['v'])} SELECT image_id, count(*) FILTER (WHERE {magnitude_sql('v')} > 64) AS edges, round(sum(abs({sobel_sql('v')[0]})), 6) AS gx, round(sum(abs({sobel_sql('v')[1]})), 6) AS gy, round(max({magnitude_sql('v')}), 6) AS strongest FROM around GROUP BY image_id")
def sobel_stats(spark, sf_dir):
    s = stencil.sobel(gray(spark, sf_dir))
    return s.groupBy("image_id").agg(F.count_if(F.col("magnitude") > 64).alias("edges"), r(F.sum(F.abs("gx"))).alias("gx"), r(F.sum(F.abs("gy"))).alias("gy"), r(F.max("magnitude")).alias("strongest"))


MAPS_SQL = f"greatest({', '.join(magnitude_sql(c) for c in 'rgb')}) AS sobel, greatest({', '.join(laplacian_sql(c) for c in 'rgb')}) AS laplacian"


@query(f"WITH {COLOUR_SQL}, {around_sql('colour', list('rgb'))}, maps AS (SELECT image_id, y, x, {MAPS_SQL} FROM around) SELECT image_id, round(sum(sobel), 4) AS sobel, round(sum(laplacian), 4) AS laplacian FROM maps GROUP BY image_id")
def edge_maps(spark, sf_dir):
    return stencil.edge_maps(colour(spark, sf_dir)).groupBy("image_id").agg(r(F.sum("sobel"), 4).alias("sobel"), r(F.sum("laplacian"), 4).alias("laplacian"))


LIMITS = {"lap_hi": 90.0, "lap_lo": 60.0, "sob_hi": 160.0, "sob_lo": 40.0}


@query(f"""WITH {COLOUR_SQL}, {around_sql('colour', list('rgb'))}, maps AS (SELECT image_id, y, x, {MAPS_SQL} FROM around),
wide AS (SELECT p.image_id, p.y, p.x, any_value(p.sobel) AS sobel, min(q.sobel) FILTER (WHERE abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2) AS low, max(q.sobel) AS near_s, max(q.laplacian) AS near_l, max(q.laplacian) FILTER (WHERE abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1) AS active
  FROM maps p JOIN maps q ON q.image_id = p.image_id AND q.y BETWEEN p.y - 3 AND p.y + 3 AND q.x BETWEEN p.x - 3 AND p.x + 3 GROUP BY p.image_id, p.y, p.x)
SELECT image_id, count(*) FILTER (WHERE seed) AS seeds, count(*) FILTER (WHERE gone) AS gone FROM (
  SELECT image_id, weak AND sobel - low > 40 AND near_s <= 160 AND near_l <= 90 AS seed, weak AND sobel - low <= 40 AND active <= 60 AS gone FROM (SELECT *, sobel > 40 AND sobel <= 160 AS weak FROM wide)) GROUP BY image_id""")
def gated_sobel(spark, sf_dir):
    return _gated(colour(spark, sf_dir))


def _gated(px: DataFrame) -> DataFrame:
    maps = stencil.edge_maps(px)
    g = stencil.gate_sobel(maps, LIMITS).withColumnRenamed("sobel", "gated").join(maps.select("image_id", "y", "x", "sobel"), ["image_id", "y", "x"])
    return g.groupBy("image_id").agg(F.count_if(F.col("gated") == float("inf")).alias("seeds"), F.count_if((F.col("gated") == 0) & (F.col("sobel") != 0)).alias("gone"))


@query(f"""WITH {GRAY_SQL}, {around_sql('gray', ['v'])}, f AS (SELECT image_id, y, x, {magnitude_sql('v')} AS mag, CAST(v - least({', '.join(f'v_{i}' for i in range(9))}) > 12 AND greatest({', '.join(f'v_{i}' for i in range(9))}) - v > 12 AS INTEGER) AS blended FROM around),
{around_sql('f', ['blended'], 'none', 'soft')} SELECT image_id, round(avg(CAST(coalesce({', '.join(f'nullif(blended_{i}, 0)' for i in range(9))}, 0) = 0 AS INTEGER)), 6) AS hard, count(*) AS edges FROM soft WHERE mag > 64 GROUP BY image_id""")
def hard_edge_share(spark, sf_dir):
    return stencil.hard_edge_share(gray(spark, sf_dir)).withColumn("hard", r("hard"))


@query(f"""WITH {COLOUR_SQL}, l AS (SELECT image_id, y, x, CAST(CAST(0.299e0 * r + 0.587e0 * g + 0.114e0 * b AS REAL) AS DOUBLE) AS v, 255 AS a FROM colour), {around_sql('l', ['v'])},
p AS (SELECT image_id, y, x, w, h, {magnitude_sql('v')} AS mag, abs(v_0 + v_2 + v_6 + v_8 - 2 * (v_1 + v_3 + v_5 + v_7) + 4 * v_4) AS resp FROM around), {around_sql('(SELECT image_id, y, x, mag, resp FROM p)', ['mag'], 'none', 'near')},
inn AS (SELECT *, avg(resp) OVER (PARTITION BY image_id) * sqrt(pi() / 2) / 6 AS sigma_all FROM near WHERE x > 0 AND y > 0 AND x < w AND y < h)
SELECT image_id, round(max(sigma_all), 5) AS sigma_all, round(coalesce(avg(resp) FILTER (WHERE greatest({', '.join(f'mag_{i}' for i in range(9))}) <= greatest(24, 3 * sigma_all)) * sqrt(pi() / 2) / 6, max(sigma_all)), 5) AS sigma FROM inn GROUP BY image_id""")
def noise_sigma(spark, sf_dir):
    out = stencil.noise_sigma(colour(spark, sf_dir).withColumn("a", F.lit(255)))
    return out.select("image_id", r("sigma_all", 5).alias("sigma_all"), r("sigma", 5).alias("sigma"))


@query(f"""WITH {COLOUR_SQL}, {around_sql('colour', list('rgb'))} SELECT image_id, {KEY_SQL} AS key, count(*) AS n,
  CAST(sum(CAST(greatest({', '.join(f'abs({c} - {c}_{i})' for c in 'rgb' for i in (1, 3, 5, 7))}) > 150 AS INTEGER)) AS BIGINT) AS edges FROM around WHERE a >= 128 GROUP BY ALL""")
def edge_pixels_per_bin(spark, sf_dir):
    return stencil.edge_pixels_per_bin(colour(spark, sf_dir), 150)


def _ramp_sql(i: int, j: int) -> str:
    dd = " + ".join(f"({c}_{j} - {c}_{i}) * ({c}_{j} - {c}_{i})" for c in "rgb")
    de = " + ".join(f"({c}_{j} - {c}_{i}) * ({c} - {c}_{i})" for c in "rgb")
    ee = " + ".join(f"({c} - {c}_{i}) * ({c} - {c}_{i})" for c in "rgb")
    t = f"(({de}) / nullif(sqrt({dd}), 0))"
    return f"coalesce(({dd}) >= 576 AND {t} >= 4 AND {t} <= sqrt({dd}) - 4 AND ({ee}) - {t} * {t} < 144, false)"


@query(f"WITH {COLOUR_SQL}, {around_sql('colour', list('rgb'), 'none')} SELECT image_id, {KEY_SQL} AS key, count(*) AS n, CAST(sum(CAST({' OR '.join(_ramp_sql(*p) for p in ((3, 5), (1, 7), (0, 8), (2, 6)))} AS INTEGER)) AS BIGINT) AS ramps FROM around WHERE a >= 128 GROUP BY ALL")
def ramp_pixels_per_bin(spark, sf_dir):
    return stencil.ramp_pixels_per_bin(colour(spark, sf_dir))


LABELS_SQL = f"{nearest_sql('colour')}, labels AS (SELECT image_id, y, x, label FROM nearest)"


def labels(spark, sf_dir):
    return pointwise.nearest(PALETTE, colour(spark, sf_dir)).select("image_id", "y", "x", "label")


@query(f"WITH {COLOUR_SQL}, {LABELS_SQL}, {around_sql('labels', ['label'])} SELECT image_id, label, count(*) AS n, CAST(sum(CAST({' AND '.join(f'label_{i} = label' for i in range(9))} AS INTEGER)) AS BIGINT) AS core FROM around GROUP BY ALL")
def core_counts(spark, sf_dir):
    return stencil.core_counts(labels(spark, sf_dir))


@query(f"WITH {GRAY_SQL} SELECT image_id, CAST(y // 8 AS INTEGER) AS y, CAST(x // 8 AS INTEGER) AS x, CAST(round_even(avg(v), 0) AS INTEGER) AS v FROM gray GROUP BY image_id, y // 8, x // 8")
def box_downscale(spark, sf_dir):
    return resample.downscale_box(gray(spark, sf_dir), 8, store=True)


@query(f"""WITH {GRAY_SQL}, d AS (SELECT image_id, max(x) AS w, max(y) AS h FROM gray GROUP BY image_id), k AS (SELECT unnest(generate_series(-3, 3)) AS k, exp(-(k * k) / 2e0) AS e), kw AS (SELECT k, e / (SELECT sum(e) FROM k) AS wt FROM k),
hx AS (SELECT p.image_id, p.y, p.x, sum(wt * q.v) AS v FROM gray p JOIN d USING (image_id), kw JOIN gray q ON q.image_id = p.image_id AND q.y = p.y AND q.x = least(greatest(p.x + k, 0), d.w) GROUP BY ALL),
hy AS (SELECT p.image_id, p.y, p.x, sum(wt * q.v) AS v FROM hx p JOIN d USING (image_id), kw JOIN hx q ON q.image_id = p.image_id AND q.x = p.x AND q.y = least(greatest(p.y + k, 0), d.h) GROUP BY ALL)
SELECT image_id, y, x, round(v, 6) AS v FROM hy""")
def gaussian_blur(spark, sf_dir):
    return resample.gaussian_blur(gray(spark, sf_dir), 1.0).withColumn("v", r("v"))


def _taps_sql(side: str, d: str, i: str) -> str:
    return f"""(SELECT image_id, {d}, n, least({side}, greatest(0, b - 1 + n)) AS {i}, n IN (1, 2) AS near,
      CASE n WHEN 0 THEN ((-0.5e0 * t + 1e0) * t - 0.5e0) * t WHEN 1 THEN (1.5e0 * t - 2.5e0) * t * t + 1e0 WHEN 2 THEN ((-1.5e0 * t + 2e0) * t + 0.5e0) * t ELSE (0.5e0 * t - 0.5e0) * t * t END AS wt
    FROM (SELECT image_id, {side}, u AS {d}, CAST(floor((u + 0.5e0) / 2 - 0.5e0) AS INTEGER) AS b, (u + 0.5e0) / 2 - 0.5e0 - floor((u + 0.5e0) / 2 - 0.5e0) AS t FROM d, LATERAL (SELECT unnest(generate_series(0, 2 * {side} + 1)) AS u)), generate_series(0, 3) z(n))"""


@query(f"""WITH {GRAY_SQL}, d AS (SELECT image_id, max(x) AS w, max(y) AS h FROM gray GROUP BY image_id), tx AS {_taps_sql('w', 'xx', 'x')}, ty AS {_taps_sql('h', 'yy', 'y')},
hx AS (SELECT g.image_id, g.y, xx, sum(wt * v) AS v, min(v) FILTER (WHERE near) AS lo, max(v) FILTER (WHERE near) AS hi FROM gray g JOIN tx USING (image_id, x) GROUP BY ALL),
hy AS (SELECT image_id, yy, xx, sum(wt * v) AS v, min(lo) FILTER (WHERE near) AS lo, max(hi) FILTER (WHERE near) AS hi FROM hx JOIN ty USING (image_id, y) GROUP BY ALL)
SELECT image_id, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, round(least(hi, greatest(lo, v)), 6) AS v FROM hy""")
def bicubic_upscale_2x(spark, sf_dir):
    return resample.upscale(gray(spark, sf_dir), 2).withColumn("v", r("v"))


@query(f"""WITH {GRAY_SQL} SELECT DISTINCT image_id, CASE WHEN image_id % 2 = 0 THEN 3 ELSE 1 END AS grid FROM gray""")
def detect_grid(spark, sf_dir):
    return _grids(gray(spark, sf_dir))


def _grids(g: DataFrame) -> DataFrame:
    g = g.select("image_id", "y", "x", *(F.col("v").alias(c) for c in "rgb"), F.lit(255).alias("a"))
    return resample.detect_grid(pointwise.upscale_nearest(g.where("image_id % 2 = 0"), 3).unionByName(g.where("image_id % 2 = 1")))


@query(f"""WITH {GRAY_SQL}, l AS (SELECT image_id, y, x, CASE WHEN v < 110 THEN 0 WHEN v > 145 THEN 1 END AS level FROM gray), k AS (SELECT * FROM l WHERE level IS NOT NULL),
t AS (SELECT *, lag(x) OVER w AS px, lag(level) OVER w AS pl FROM k WINDOW w AS (PARTITION BY image_id, y ORDER BY x)), c AS (SELECT image_id, y, (x + px + 1) / 2e0 AS crossing FROM t WHERE level <> pl AND x - px <= 4)
SELECT image_id, cell, round(sqrt(sum(cos(2 * pi() * crossing / cell)) ** 2 + sum(sin(2 * pi() * crossing / cell)) ** 2) / count(*), 6) AS coherence, count(*) AS n FROM c, (VALUES (6e0), (8e0), (10e0)) p(cell) GROUP BY ALL""")
def phase_coherence(spark, sf_dir):
    g = gray(spark, sf_dir)
    levels = g.select("image_id", "y", "x", F.when(F.col("v") < 110, 0).when(F.col("v") > 145, 1).alias("level"))
    return stencil.phase_coherence(stencil.line_transitions(levels), [6, 8, 10]).select("image_id", "cell", r("coherence").alias("coherence"), "n")


@query("SELECT CAST(i // 40 AS INTEGER) AS y, CAST(i % 40 AS INTEGER) AS x, CAST((floor((i % 40 + 0.5e0 - 1.5e0) / 7.25e0) + floor((i // 40 + 0.5e0 - 3e0) / 7.25e0)) % 2 + 2 AS INTEGER) % 2 AS parity FROM generate_series(0, 1599) t(i)")
def checker_parity(spark, sf_dir):
    grid = spark.range(1600).select(F.floor(F.col("id") / 40).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"))
    return grid.withColumn("parity", numeric.parity("x", "y", F.lit(7.25), F.lit(1.5), F.lit(3.0)))


# Layers and regions


@query(f"WITH {COLOUR_SQL}, {LABELS_SQL} SELECT image_id, label, count(*) AS n, CAST(row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, label) - 1 AS INTEGER) AS rank FROM labels GROUP BY image_id, label")
def layer_order(spark, sf_dir):
    return masks.layer_order(labels(spark, sf_dir))


RANKS_SQL = "o AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, label) - 1 AS rank FROM labels GROUP BY image_id, label), ranks AS (SELECT l.image_id, y, x, rank FROM labels l JOIN o USING (image_id, label))"


def ranks(spark, sf_dir):
    px = labels(spark, sf_dir)
    return masks.ranked(px, masks.layer_order(px))


@query(f"WITH {COLOUR_SQL}, {LABELS_SQL}, {RANKS_SQL} SELECT image_id, CAST(layer AS INTEGER) AS layer, count(*) AS n FROM ranks, generate_series(0, 3) t(layer) WHERE rank >= layer GROUP BY ALL")
def nested_masks_area(spark, sf_dir):
    return masks.nested_masks(ranks(spark, sf_dir)).groupBy("image_id", "layer").agg(F.count("*").alias("n"))


CROSS = "(VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o5(dy, dx)"


@query(f"WITH {COLOUR_SQL}, {LABELS_SQL}, {RANKS_SQL}, c AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x, rank AS layer FROM ranks, {CROSS}) SELECT c.image_id, CAST(c.layer AS INTEGER) AS layer, count(*) AS n FROM c JOIN ranks r ON r.image_id = c.image_id AND r.y = c.y AND r.x = c.x GROUP BY ALL")
def cutout_masks_area(spark, sf_dir):
    return masks.cutout_masks(ranks(spark, sf_dir)).groupBy("image_id", "layer").agg(F.count("*").alias("n"))


@query(f"WITH {COLOUR_SQL}, {LABELS_SQL}, {RANKS_SQL}, c AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM ranks, {CROSS} WHERE rank = 1) SELECT r.image_id, count(*) AS n FROM ranks r JOIN c USING (image_id, y, x) WHERE rank >= 1 GROUP BY ALL")
def region_mask_cutout(spark, sf_dir):
    return masks.region_mask(ranks(spark, sf_dir), 1, True, 1).groupBy("image_id").agg(F.count("*").alias("n"))


REGIONS_SQL = "px AS (SELECT g.image_id, g.y, g.x, (g.y // 16) * 4 + g.x // 16 AS region, g.v AS r, coalesce(q.v, 0) AS g, 255 - g.v AS b FROM gray g LEFT JOIN gray q ON q.image_id = g.image_id AND q.y = g.x AND q.x = g.y)"


def regions(spark, sf_dir):
    """Blocks of 16 by 16 with a made-up second channel."""
    g = gray(spark, sf_dir)
    turned = g.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), F.col("v").alias("g"))
    rows = g.join(turned, ["image_id", "y", "x"], "left")
    region = (F.floor(F.col("y") / 16) * 4 + F.floor(F.col("x") / 16)).cast("int")
    return rows.select("image_id", "y", "x", region.alias("region"), F.col("v").alias("r"), F.coalesce("g", F.lit(0)).alias("g"), (255 - F.col("v")).alias("b"))


SUMS_SQL = "m AS (SELECT image_id, region, CAST(count(*) AS DOUBLE) AS n, sum(x + 0.5e0) AS sx, sum(y + 0.5e0) AS sy, sum((x + 0.5e0) * (x + 0.5e0)) AS sxx, sum((x + 0.5e0) * (y + 0.5e0)) AS sxy, sum((y + 0.5e0) * (y + 0.5e0)) AS syy, " + ", ".join(f"CAST(sum({c}) AS DOUBLE) AS s{c}, sum({c} * (x + 0.5e0)) AS sx{c}, sum({c} * (y + 0.5e0)) AS sy{c}" for c in "rgb") + ", CAST(sum(r * r + g * g + b * b) AS DOUBLE) AS scc FROM px GROUP BY ALL)"
MOMENTS = ["n", "sx", "sy", "sxx", "sxy", "syy", *(f"s{k}{c}" for c in "rgb" for k in ("", "x", "y")), "scc"]


@query(f"WITH {GRAY_SQL}, {REGIONS_SQL}, {SUMS_SQL} SELECT image_id, CAST(region AS INTEGER) AS region, {', '.join(MOMENTS)} FROM m")
def region_moments(spark, sf_dir):
    return masks.moments(regions(spark, sf_dir)).select("image_id", "region", *MOMENTS)


@query(f"WITH {GRAY_SQL}, {REGIONS_SQL} SELECT image_id, CAST(region AS INTEGER) AS region, round(avg(r), 6) AS mean_r, round(avg(g), 6) AS mean_g, round(avg(b), 6) AS mean_b, round(sqrt((var_pop(r) + var_pop(g) + var_pop(b)) / 3), 6) AS rmse FROM px GROUP BY ALL")
def flat_fit(spark, sf_dir):
    f = masks.flat_fit(masks.moments(regions(spark, sf_dir)))
    return f.select("image_id", "region", *(r(f"mean_{c}").alias(f"mean_{c}") for c in "rgb"), r("rmse_flat").alias("rmse"))


@query(f"""WITH {GRAY_SQL}, {REGIONS_SQL}, c AS (SELECT image_id, region, covar_pop(x, r) AS xr, covar_pop(y, r) AS yr, covar_pop(x, g) AS xg, covar_pop(y, g) AS yg, covar_pop(x, b) AS xb, covar_pop(y, b) AS yb, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy FROM px GROUP BY ALL)
SELECT image_id, CAST(region AS INTEGER) AS region, {', '.join(f"round((x{c} * vy - y{c} * vxy) / (vx * vy - vxy * vxy), 10) AS gx_{c}, round((y{c} * vx - x{c} * vxy) / (vx * vy - vxy * vxy), 10) AS gy_{c}" for c in 'rgb')} FROM c""")
def plane_fit(spark, sf_dir):
    p = masks.plane_fit(masks.moments(regions(spark, sf_dir)))
    return p.select("image_id", "region", *(r(f"g{d}_{c}", 10).alias(f"g{d}_{c}") for c in "rgb" for d in "xy"))


@query(f"""WITH {GRAY_SQL}, {REGIONS_SQL}, c AS (SELECT image_id, region, covar_pop(x, r) / var_pop(x) AS xr, covar_pop(y, r) / var_pop(y) AS yr, covar_pop(x, g) / var_pop(x) AS xg, covar_pop(y, g) / var_pop(y) AS yg, covar_pop(x, b) / var_pop(x) AS xb, covar_pop(y, b) / var_pop(y) AS yb FROM px GROUP BY ALL),
q AS (SELECT image_id, region, xr * xr + xg * xg + xb * xb AS p, xr * yr + xg * yg + xb * yb AS o, yr * yr + yg * yg + yb * yb AS s FROM c)
SELECT image_id, CAST(region AS INTEGER) AS region, round(sqrt(((p + s) + sqrt((p - s) * (p - s) + 4 * o * o)) / 2), 6) AS strength FROM q""")
def plane_axis(spark, sf_dir):
    return masks.plane_axis(masks.plane_fit(masks.moments(regions(spark, sf_dir)))).select("image_id", "region", r("strength").alias("strength"))


@query(f"""WITH {COLOUR_SQL}, {LABELS_SQL} SELECT image_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, count(*) AS length FROM (
  SELECT p.image_id, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM labels p JOIN labels q ON q.image_id = p.image_id AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) WHERE p.label <> q.label) GROUP BY ALL""")
def region_adjacency(spark, sf_dir):
    return masks.region_adjacency(labels(spark, sf_dir).withColumnRenamed("label", "region"))


@query(f"WITH {COLOUR_SQL}, {LABELS_SQL} SELECT image_id, label AS region, count(*) AS area FROM labels GROUP BY ALL")
def region_area(spark, sf_dir):
    return labels(spark, sf_dir).groupBy("image_id", F.col("label").alias("region")).agg(F.count("*").alias("area"))


@query(f"""WITH {COLOUR_SQL}, {LABELS_SQL}, p AS (SELECT p.image_id, p.y, p.x FROM labels p WHERE NOT EXISTS (SELECT 1 FROM labels q WHERE q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND q.label <> p.label)) SELECT image_id, count(*) AS n FROM p GROUP BY image_id""")
def deep_band(spark, sf_dir):
    return stencil.deep_band(labels(spark, sf_dir).withColumnRenamed("label", "region"), 1).groupBy("image_id").agg(F.count("*").alias("n"))


# Similarity

SHIFT_SQL = "side AS (SELECT image_id, max(y) + 1 AS h FROM gray GROUP BY image_id), pairs AS (SELECT p.image_id, p.y, p.x, p.v, q.v AS v2, h FROM gray p JOIN side USING (image_id) JOIN gray q ON q.image_id = p.image_id AND q.x = p.x AND q.y = (p.y + 1) % h)"


def pairs(spark, sf_dir):
    g = gray(spark, sf_dir)
    return metrics.paired(g, shifted(g))


@query(f"WITH {GRAY_SQL}, {SHIFT_SQL} SELECT image_id, round(avg(abs(v - v2)), 6) AS mae FROM pairs GROUP BY image_id")
def mean_absolute_error(spark, sf_dir):
    return metrics.mean_absolute_error(pairs(spark, sf_dir)).withColumn("mae", r("mae"))


@query(f"WITH {GRAY_SQL}, {SHIFT_SQL} SELECT image_id, round(sum(CAST(v < 128 AND v2 < 128 AS INTEGER)) / sum(CAST(v < 128 OR v2 < 128 AS INTEGER)), 6) AS iou FROM pairs GROUP BY image_id")
def mask_iou(spark, sf_dir):
    p = pairs(spark, sf_dir).select("image_id", (F.col("v") < 128).cast("int").alias("m"), (F.col("v2") < 128).cast("int").alias("m2"))
    return metrics.iou(p).withColumn("iou", r("iou"))


@query(f"WITH {COLOUR_SQL} SELECT p.image_id, round(avg(CAST(greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) > 100 AS INTEGER)), 6) AS different FROM colour p JOIN colour q ON q.image_id = p.image_id AND q.y = p.y AND q.x = (p.x + 1) % 32 GROUP BY p.image_id")
def share_different(spark, sf_dir):
    c = colour(spark, sf_dir)
    moved = c.withColumn("x", F.pmod(F.col("x") + F.lit(31), F.lit(32)))
    return metrics.share_different(metrics.paired(c, moved, ("r", "g", "b")), 100).withColumn("different", r("different"))


SSIM_SQL = """win AS (SELECT image_id, wy, wx, avg(CAST(v AS DOUBLE)) AS a, avg(CAST(v2 AS DOUBLE)) AS b, var_pop(v) AS va, var_pop(v2) AS vb, covar_pop(v, v2) AS cov
  FROM pairs JOIN (SELECT unnest(generate_series(0, 14)) AS wy) ON y BETWEEN 4 * wy AND 4 * wy + 7 AND (wy = 0 OR 4 * wy + 8 <= h) JOIN (SELECT unnest(generate_series(0, 14)) AS wx) ON x BETWEEN 4 * wx AND 4 * wx + 7 GROUP BY ALL),
s AS (SELECT image_id, avg((2 * a * b + 6.5025e0) * (2 * cov + 58.5225e0) / ((a * a + b * b + 6.5025e0) * (va + vb + 58.5225e0))) AS ssim, count(*) AS windows FROM win GROUP BY image_id)"""


@query(f"WITH {GRAY_SQL}, {SHIFT_SQL}, {SSIM_SQL} SELECT image_id, round(ssim, 6) AS ssim, windows FROM s")
def ssim(spark, sf_dir):
    return metrics.ssim(pairs(spark, sf_dir)).withColumn("ssim", r("ssim"))


@query(f"""WITH {GRAY_SQL}, {SHIFT_SQL}, {SSIM_SQL}, i AS (SELECT image_id, sum(CAST(v < 128 AND v2 < 128 AS INTEGER)) / sum(CAST(v < 128 OR v2 < 128 AS INTEGER)) AS iou FROM pairs GROUP BY image_id)
SELECT image_id, round(0.6e0 * ssim + 0.4e0 * iou, 6) AS fidelity, round(0.6e0 * ssim + 0.4e0 * iou - 0.15e0 * 0.25e0 - 0.1e0 * least(1, 40 / (2 * 100e0)), 6) AS score FROM s JOIN i USING (image_id)""")
def fidelity_and_score(spark, sf_dir):
    p = pairs(spark, sf_dir)
    both = metrics.ssim(p).join(metrics.iou(p.select("image_id", (F.col("v") < 128).cast("int").alias("m"), (F.col("v2") < 128).cast("int").alias("m2"))), "image_id")
    f = metrics.fidelity(F.col("ssim"), F.col("iou"))
    return both.select("image_id", r(f).alias("fidelity"), r(metrics.tuner_score(f, F.lit(0.25), F.lit(40), F.lit(100.0))).alias("score"))
