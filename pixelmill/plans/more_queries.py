"""Queries of parameters, rules, paths and whole-image plans; those that SQL can express have it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats, numeric, params
from ..operators import checker, colour, masks, stencil, vector
from ..sources import images, svg, synth, tables
from ..sources.tables import COLOUR_SQL, DENSITY_SQL, GRAY_SQL
from ..streaming import requests
from . import rules, trace
from .queries import LABELS_SQL, labels, query, r


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


# Parameters and formats

PARAMS_SQL = """p AS (SELECT p_partkey AS image_id, p_size * 40 AS width, p_size * 25 AS height, p_retailprice / 1000 - 0.5e0 AS blur_k, p_size / 10e0 AS alphamax, p_size * 3 AS turdsize,
  CASE p_partkey % 5 WHEN 0 THEN 'lines' WHEN 1 THEN 'flat' WHEN 2 THEN 'gradient' WHEN 3 THEN 'pixel' END AS mode, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS colors FROM part),
m AS (SELECT *, coalesce(mode, 'lines') AS md, greatest(1, CAST(floor(sqrt(16e6 / (width * height))) AS INTEGER)) AS most FROM p),
u AS (SELECT *, CASE WHEN least(width, height) <= 512 THEN 4 WHEN least(width, height) <= 1024 THEN 2 ELSE most END AS want FROM m)"""


@query(f"""WITH {PARAMS_SQL} SELECT image_id, md AS mode, CAST(CASE WHEN md = 'pixel' THEN 1 ELSE least(want, most) END AS INTEGER) AS upscale, md <> 'pixel' AND most < want AS capped,
  round(least(1, greatest(0, blur_k)), 6) AS blur_k, round(least(1.334e0, alphamax), 6) AS alphamax, CAST(least(100, turdsize) AS DOUBLE) AS turdsize, CASE WHEN md = 'gradient' THEN 'cutout' ELSE 'stacked' END AS layering,
  CASE WHEN colors IS NOT NULL THEN CAST(least(32, greatest(2, colors)) AS INTEGER) END AS colors, round(CASE WHEN md = 'pixel' THEN 0 ELSE least(1, greatest(0, blur_k)) * least(want, most) END, 6) AS sigma FROM u""")
def resolve_params(spark, sf_dir):
    p, k = _part(spark, sf_dir), F.col("p_partkey") % 5
    mode = F.when(k == 0, "lines").when(k == 1, "flat").when(k == 2, "gradient").when(k == 3, "pixel")
    given = p.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 40).alias("width"), (F.col("p_size") * 25).alias("height"), (F.col("p_retailprice") / 1000 - 0.5).alias("blur_k"), (F.col("p_size") / F.lit(10.0)).alias("alphamax"), (F.col("p_size") * 3).alias("turdsize"), mode.alias("mode"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).alias("colors"))
    out = params.resolve(given)
    return out.select("image_id", "mode", "upscale", F.col("upscale_capped").alias("capped"), r("blur_k").alias("blur_k"), r("alphamax").alias("alphamax"), "turdsize", "layering", "colors", r("sigma").alias("sigma"))


@query("SELECT p_partkey AS image_id, CAST(CASE WHEN p_size * 100 <= 256 THEN 1 ELSE ceil(p_size * 100 / 256e0) END AS INTEGER) AS tuner, CAST(greatest(1, ceil(sqrt(p_size * 100e0 * p_size * 80 / 4e6))) AS INTEGER) AS gradient FROM part")
def proxy_factors(spark, sf_dir):
    w, h = F.col("p_size") * 100, F.col("p_size") * 80
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("image_id"), params.proxy_factor(w, h).alias("tuner"), params.gradient_proxy_factor(w, h).alias("gradient"))


@query(f"WITH {COLOUR_SQL} SELECT image_id, y, x, printf('#%02x%02x%02x', r, g, b) AS hex, CAST(r AS BIGINT) * 16777216 + g * 65536 + b * 256 + a AS packed, {'(r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3)'} AS key FROM colour")
def colour_codes(spark, sf_dir):
    return tables.colour(spark, sf_dir).select("image_id", "y", "x", numeric.hex_colour().alias("hex"), numeric.packed_rgba().alias("packed"), numeric.colour_key().alias("key"))


FNV_SQL = "WITH RECURSIVE w AS (SELECT p_partkey, p_name, 0 AS i, CAST(2166136261 AS BIGINT) AS h FROM part UNION ALL SELECT p_partkey, p_name, i + 1, CAST((xor(h, CAST(ord(substr(p_name, i + 1, 1)) AS BIGINT)) * 16777619) % 4294967296 AS BIGINT) FROM w WHERE i < length(p_name)) SELECT p_partkey, h AS hash FROM w WHERE i = length(p_name)"


@query(FNV_SQL)
def fnv_ids(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", numeric.fnv1a("p_name").alias("hash"))


@query("SELECT page_id, lower(regexp_extract(url, '\\.([a-z0-9]{1,8})$', 1)) <> '' AS has_extension, octet_length(encode(html)) AS bytes FROM pages")
def file_names(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", (formats.extension(F.col("url")) != "").alias("has_extension"), formats.utf8_length(F.col("html")).cast("long").alias("bytes"))


HEADS = {"png": "89504E470D0A1A0A0000", "jpeg": "FFD8FFE000104A46", "gif": "4749463839610100", "bmp": "424D36000000", "webp": "524946462400000057454250", "none": "3C73766720786D6C"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {'NULL' if k == 'none' else repr(k)})" for k in HEADS) + ") t(name, kind)")
def sniffed_kinds(spark, sf_dir):
    return spark.createDataFrame(list(HEADS.items()), "name string, head string").select("name", formats.sniff_kind(F.unhex("head")).alias("kind"))


# Rules and search

FACTS_SQL = """f AS (SELECT user_id AS image_id, CAST(count(*) AS INTEGER) AS n, CAST(min(event_id) % 9 AS INTEGER) AS grid, round(avg(value) / 100, 3) AS share, CAST(max(event_id) % 40 AS INTEGER) AS colours, min(event_id) % 2 = 0 AS bimodal FROM events GROUP BY user_id),
g AS (SELECT image_id, (100 + n * 9) * CASE WHEN image_id % 16 = 0 THEN 100 ELSE 1 END AS width, (60 + n * 9) * CASE WHEN image_id % 16 = 0 THEN 100 ELSE 1 END AS height, CASE WHEN grid < 7 THEN 1 ELSE grid END AS grid, share * 1.2e0 AS hard_edges, share / 6 AS transparent, CASE WHEN colours < 33 THEN colours END AS colours, share / 3 AS off_palette, bimodal, share AS thin, 1 - share / 4 AS explained, share / 5 AS gradient_share, share AS edge_share, n * 12 AS regions, share * 0.8e0 AS two_tone_off FROM f)"""


def made_up_facts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    f = e.groupBy(F.col("user_id").alias("image_id")).agg(F.count("*").cast("int").alias("n"), (F.min("event_id") % 9).cast("int").alias("grid"), F.round(F.avg("value") / 100, 3).alias("share"), (F.max("event_id") % 40).cast("int").alias("c"), (F.min("event_id") % 2 == 0).alias("bimodal"))
    s = F.col("share")
    scale = F.when(F.col("image_id") % 16 == 0, 100).otherwise(1)
    return f.select("image_id", ((100 + F.col("n") * 9) * scale).alias("width"), ((60 + F.col("n") * 9) * scale).alias("height"), (s * 0.8).alias("two_tone_off"), F.when(F.col("grid") < 7, 1).otherwise(F.col("grid")).alias("grid"), (s * 1.2).alias("hard_edges"), (s / 6).alias("transparent"), F.when(F.col("c") < 33, F.col("c")).alias("colours"), (s / 3).alias("off_palette"), "bimodal", s.alias("thin"), (1 - s / 4).alias("explained"), (s / 5).alias("gradient_share"), s.alias("edge_share"), (F.col("n") * 12).alias("regions"))


FLAT_SQL = "(colours IS NOT NULL AND off_palette * (1 - transparent) <= 0.15e0)"


@query(f"""WITH {FACTS_SQL}, d AS (SELECT image_id, thin, width, height, CASE WHEN grid >= 2 THEN 'grid' WHEN hard_edges > 0.9e0 AND least(width, height) <= 128 AND CAST(width AS BIGINT) * height <= 1000000 THEN 'hard edges'
  WHEN colours <= CASE WHEN transparent > 0.05e0 THEN 1 ELSE 2 END AND off_palette <= 0.5e0 THEN 'few colours' WHEN transparent <= 0.05e0 AND colours IS NULL AND bimodal AND two_tone_off <= 0.5e0 THEN 'two tones'
  WHEN edge_share <= 0.6e0 AND regions <= 400 AND explained >= 0.85e0 AND (NOT {FLAT_SQL} OR gradient_share >= 0.05e0) THEN 'gradients' WHEN {FLAT_SQL} THEN 'flat palette' ELSE 'photo' END AS reason FROM g),
e AS (SELECT *, CASE reason WHEN 'grid' THEN 'pixel' WHEN 'hard edges' THEN 'pixel' WHEN 'few colours' THEN 'lines' WHEN 'two tones' THEN 'lines' WHEN 'gradients' THEN 'gradient' ELSE 'flat' END AS mode FROM d)
SELECT image_id, mode, reason, CASE WHEN reason = 'photo' THEN 16 END AS photo_colours, concat_ws(',', CASE WHEN mode = 'lines' AND thin > 0.5e0 THEN 'thin-strokes' END, CASE WHEN reason = 'photo' THEN 'photo' END, CASE WHEN CAST(width AS BIGINT) * height > 16000000 THEN 'large-input' END) AS codes FROM e""")
def classify_rules(spark, sf_dir):
    return rules.warnings(rules.decide_mode(made_up_facts(spark, sf_dir))).select("image_id", "mode", "reason", "photo_colours", F.array_join("warnings", ",").alias("codes"))


@query("""SELECT CAST(row_number() OVER (ORDER BY i, j, k, l) - 1 AS INTEGER) AS seq, u AS upscale, b AS blur_k, a AS alphamax, t AS turdsize
FROM (VALUES (0, 2), (1, 4)) w(i, u), (VALUES (0, 0e0), (1, 0.5e0), (2, 0.9e0)) x(j, b), (VALUES (0, 0.6e0), (1, 1e0), (2, 1.334e0)) y(k, a), (VALUES (0, 1), (1, 4)) z(l, t)""")
def tuner_grid_a(spark, sf_dir):
    return rules.stage_a(spark).drop("opttolerance")


@query("""SELECT CAST(s AS INTEGER) AS seed, CAST((k + 3) * 3 + j AS INTEGER) AS seq, round(least(1.334e0, greatest(0, floor((c + k * 0.05e0) * 1000 + 0.5e0) / 1000)), 6) AS alphamax, o AS opttolerance
FROM (VALUES (0, 0.1e0), (1, 1.3e0)) a(s, c), generate_series(-3, 3) b(k), (VALUES (0, 0.1e0), (1, 0.2e0), (2, 0.4e0)) d(j, o)""")
def tuner_grid_b(spark, sf_dir):
    seeds = spark.createDataFrame([(0, 2, 0.0, 0.1, 1), (1, 4, 0.5, 1.3, 4)], "seq int, upscale int, blur_k double, alphamax double, turdsize int")
    return rules.stage_b(seeds).select("seed", "seq", r("alphamax").alias("alphamax"), "opttolerance")


RESULTS_SQL = "res AS (SELECT user_id AS image_id, event_id AS seq, CAST(floor(value / 10) AS BIGINT) AS key, round(value, 1) AS score, event_type <> 'view' AS eligible, event_id % 7 AS corners, event_id % 3 AS nodes, (event_id % 10) / 10e0 AS fidelity FROM events)"


def made_up_results(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("image_id"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 10).alias("key"), F.round("value", 1).alias("score"), (F.col("event_type") != "view").alias("eligible"), (F.col("event_id") % 7).alias("corners"), (F.col("event_id") % 3).alias("nodes"), ((F.col("event_id") % 10) / F.lit(10.0)).alias("fidelity"))


@query(f"""WITH {RESULTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN eligible THEN 0 ELSE 1 END, score DESC, seq) AS k FROM res),
s AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM o z WHERE z.image_id = o.image_id AND z.key = o.key AND z.k < o.k) THEN 1 ELSE 0 END AS rep FROM o)
SELECT image_id, seq, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rep, k) AS place FROM s) WHERE place <= 3""")
def pick_seeds(spark, sf_dir):
    return rules.pick_seeds(made_up_results(spark, sf_dir)).select("image_id", "seq", "place")


@query(f"""WITH {RESULTS_SQL} SELECT image_id, seq, score FROM res a WHERE fidelity >= 0.4e0 AND NOT EXISTS (SELECT 1 FROM res b WHERE b.image_id = a.image_id AND b.fidelity >= 0.4e0
  AND (b.score > a.score OR (b.score = a.score AND (b.corners < a.corners OR (b.corners = a.corners AND (b.nodes < a.nodes OR (b.nodes = a.nodes AND b.seq < a.seq)))))))""")
def outranking_result(spark, sf_dir):
    return rules.best_result(made_up_results(spark, sf_dir), F.lit(0.4)).select("image_id", "seq", "score")


# Paths

SEGS_SQL = """segs AS (SELECT p_partkey // 10 AS image_id, p_partkey // 5 AS path, p_partkey AS seq, CASE WHEN p_partkey % 5 = 0 THEN 'M' WHEN p_partkey % 5 = 4 THEN 'Z' WHEN p_size % 3 = 0 THEN 'C' ELSE 'L' END AS kind, p_size AS s, p_retailprice AS v FROM part),
pts AS (SELECT image_id, path, seq, kind, CASE WHEN kind = 'C' THEN s - 0.25e0 END AS x1, CASE WHEN kind = 'C' THEN v + 1 END AS y1, CASE WHEN kind = 'C' THEN s + 0.5e0 END AS x2, CASE WHEN kind = 'C' THEN v - 2 END AS y2, CASE WHEN kind <> 'Z' THEN CAST(s AS DOUBLE) END AS x, CASE WHEN kind <> 'Z' THEN v END AS y FROM segs)"""


def made_up_segments(spark, sf_dir):
    k, s, v = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    kind = F.when(k % 5 == 0, "M").when(k % 5 == 4, "Z").when(s % 3 == 0, "C").otherwise("L")
    curve = lambda c: F.when(kind == "C", c)
    return _part(spark, sf_dir).select(F.floor(k / 10).alias("image_id"), F.floor(k / 5).alias("path"), k.alias("seq"), kind.alias("kind"), curve(s - 0.25).alias("x1"), curve(v + 1).alias("y1"), curve(s + 0.5).alias("x2"), curve(v - 2).alias("y2"), F.when(kind != "Z", s.cast("double")).alias("x"), F.when(kind != "Z", v).alias("y"))


@query(f"WITH {SEGS_SQL}, c AS (SELECT image_id, count(*) FILTER (WHERE kind = 'M') AS paths, count(*) FILTER (WHERE kind IN ('L', 'C')) AS nodes, count(*) FILTER (WHERE kind = 'L') AS corners, count(*) FILTER (WHERE kind = 'C') AS curves FROM pts GROUP BY image_id) SELECT *, round(CASE WHEN nodes > 0 THEN corners / nodes ELSE 0 END, 6) AS corner_share FROM c")
def path_stats(spark, sf_dir):
    return vector.path_stats(made_up_segments(spark, sf_dir)).withColumn("corner_share", r("corner_share"))


@query(f"WITH {SEGS_SQL} SELECT image_id, min(least(x, coalesce(x1, x), coalesce(x2, x))) AS x0, round(min(least(y, coalesce(y1, y), coalesce(y2, y))), 6) AS y0, max(greatest(x, coalesce(x1, x), coalesce(x2, x))) AS x1, round(max(greatest(y, coalesce(y1, y), coalesce(y2, y))), 6) AS y1 FROM pts WHERE kind <> 'Z' GROUP BY image_id")
def path_bounds(spark, sf_dir):
    return vector.path_bounds(made_up_segments(spark, sf_dir)).select("image_id", "x0", r("y0").alias("y0"), "x1", r("y1").alias("y1"))


@query(f"WITH {SEGS_SQL} SELECT a.image_id, a.path, a.seq, coalesce(a.kind = (SELECT b.kind FROM pts b WHERE b.path = a.path AND b.seq < a.seq ORDER BY b.seq DESC LIMIT 1) AND a.kind NOT IN ('M', 'Z'), false) AS implicit FROM pts a")
def repeated_commands(spark, sf_dir):
    return vector.repeated_commands(made_up_segments(spark, sf_dir)).select("image_id", "path", "seq", "implicit")


@query("""WITH q AS (SELECT p_partkey // 20 AS image_id, p_partkey AS seq, p_size % 4 AS colour, p_size AS x, CAST(p_partkey % 20 AS INTEGER) AS y FROM part)
SELECT image_id, seq, x - coalesce(lag(x) OVER w, 0) AS dx, y - coalesce(lag(y) OVER w, 0) AS dy FROM q WINDOW w AS (PARTITION BY image_id, colour ORDER BY seq)""")
def relative_rect_moves(spark, sf_dir):
    p = _part(spark, sf_dir).select(F.floor(F.col("p_partkey") / 20).alias("image_id"), F.col("p_partkey").alias("seq"), (F.col("p_size") % 4).alias("colour"), F.col("p_size").alias("x"), (F.col("p_partkey") % 20).cast("int").alias("y"))
    return vector.relative_moves(p).select("image_id", "seq", "dx", "dy")


@query("""WITH b AS (SELECT p_partkey AS image_id, p_size / 8e0 AS x0, 1 + p_size / 8e0 + (p_partkey % 7) / 3e0 AS x1, (p_partkey % 5) / 4e0 AS y0, 2 + (p_partkey % 11) / 5e0 AS y1 FROM part),
j AS (SELECT *, CAST(t AS INTEGER) AS j FROM b, generate_series(0, 39) g(t) WHERE (t + 0.5e0) / 4 >= y0 AND (t + 0.5e0) / 4 < y1),
c AS (SELECT image_id, j // 4 AS y, CAST(s AS INTEGER) AS x, least(x1, s + 1) - greatest(x0, s) AS part FROM j, generate_series(0, 20) h(s) WHERE least(x1, s + 1) > greatest(x0, s))
SELECT image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(sum(part) / 4, 6) AS coverage FROM c GROUP BY ALL""")
def raster_coverage(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size") / F.lit(8.0)
    box = _part(spark, sf_dir).select(k.alias("image_id"), s.alias("a"), (1 + s + (k % 7) / F.lit(3.0)).alias("b"), ((k % 5) / F.lit(4.0)).alias("c"), (2 + (k % 11) / F.lit(5.0)).alias("d"))
    edges = box.select("image_id", F.expr("stack(4, a, c, b, c, b, c, b, d, b, d, a, d, a, d, a, c) AS (x1, y1, x2, y2)"))
    return vector.coverage(edges).withColumn("coverage", r("coverage"))


STOP_ROWS = [(0.0, 10.0, 200.0, 30.0), (0.25, 90.0, 20.0, 60.0), (0.25, 40.0, 80.0, 100.0), (0.75, 250.0, 0.0, 5.0)]


@query("""WITH q AS (SELECT p_partkey, p_size / 50e0 AS t FROM part) SELECT p_partkey, round(t, 6) AS t, round(CASE WHEN t < 0.25e0 THEN 10 + (90 - 10) * t / 0.25e0 WHEN t < 0.75e0 THEN 40 + (250 - 40) * (t - 0.25e0) / 0.5e0 ELSE 250 END, 6) AS r,
  round(0.25e0 * (10 + 90) / 2 + 0.5e0 * (40 + 250) / 2 + 250 * 0.25e0, 6) AS mean_r FROM q""")
def gradient_colours(spark, sf_dir):
    stops = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(s, ("offset", "r", "g", "b")))) for s in STOP_ROWS))
    rows = _part(spark, sf_dir).select("p_partkey", vector.gradient_t(F.col("p_size") * 1.0, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(50.0), F.lit(0.0)).alias("t"), vector.normalised_stops(stops).alias("stops"))
    return rows.select("p_partkey", r("t").alias("t"), r(vector.stop_colour(F.col("t"), F.col("stops"), "r")).alias("r"), r(vector.mean_colour(F.col("stops"), "r")).alias("mean_r"))


# Masks


@query(f"WITH {COLOUR_SQL}, {LABELS_SQL} SELECT image_id, count(*) FILTER (WHERE label = 1 AND x < 16) AS both, count(*) FILTER (WHERE label = 1 OR x < 16) AS any_, count(*) FILTER (WHERE label <> 1) AS none FROM labels GROUP BY image_id")
def mask_algebra(spark, sf_dir):
    px = labels(spark, sf_dir)
    a, b = px.where("label = 1"), px.where("x < 16")
    n = lambda d, name: d.groupBy("image_id").agg(F.count("*").alias(name))
    all_ = n(px, "every").join(n(masks.intersection(a, b), "both"), "image_id", "left").join(n(masks.union(a, b), "any_"), "image_id", "left").join(n(masks.complement(px, a), "none"), "image_id", "left")
    return all_.select("image_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("both", "any_", "none")))


@query(f"""WITH RECURSIVE {DENSITY_SQL}, ink AS (SELECT image_id, y, x FROM density WHERE v >= (SELECT median(v) FROM density) + 1),
reach AS (SELECT image_id, y, x, y AS ry, x AS rx FROM ink UNION SELECT i.image_id, i.y, i.x, r.ry, r.rx FROM reach r JOIN ink i ON i.image_id = r.image_id AND abs(i.y - r.y) + abs(i.x - r.x) = 1),
root AS (SELECT image_id, y, x, min(ry * 100 + rx) AS root FROM reach GROUP BY ALL)
SELECT image_id, count(DISTINCT root) AS pieces, count(*) AS ink FROM root GROUP BY image_id""")
def components_small(spark, sf_dir):
    d = tables.density(spark, sf_dir)
    middle = d.agg(F.median("v").alias("middle"))  # one row
    ink = d.crossJoin(F.broadcast(middle)).where("v >= middle + 1").select("image_id", "y", "x", F.lit(1).alias("m"))
    return trace.connected_components(ink).groupBy("image_id").agg(F.count_distinct("region").alias("pieces"), F.count("*").alias("ink"))


# Streams of requests


@query("SELECT user_id % 10 AS session, event_id AS id, event_id < max(event_id) OVER (PARTITION BY user_id % 10, event_type) AS superseded FROM events")
def latest_requests(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 10).alias("session"), F.col("event_id").alias("id"), F.col("event_type").alias("channel"))
    return requests.latest_wins(e).drop("channel")


@query(f"WITH {RESULTS_SQL} SELECT image_id, seq, count(*) OVER w AS done, count(*) OVER (PARTITION BY image_id) AS total, max(score) OVER w AS best FROM res WINDOW w AS (PARTITION BY image_id ORDER BY seq)")
def progress_events(spark, sf_dir):
    return requests.progress(made_up_results(spark, sf_dir))


@query()
def served_requests(spark, sf_dir):
    """Events as requests of ten sessions; tests hold the answers against a simulation."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("trace", "classify", "tune", "compare", "setSource", "cancel", "init", "other"))), (k * 7 % 8 + 1).cast("int"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return requests.serve(e.select((F.col("user_id") % 10).alias("session"), k.alias("id"), kind.alias("kind"), F.when(kind == "cancel", k - k % 5).alias("target"), (k * 3.0).alias("at"), (F.col("value") / 10).alias("takes")))


@query("""SELECT image_id, key FROM (SELECT p_partkey AS image_id, '{' || concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN '"colors":' || p_size END, CASE WHEN p_partkey % 5 > 0 THEN '"mode":"' || CASE WHEN p_size > 25 THEN 'flat' ELSE 'lines' END || '"' END, '"turdsize":' || p_size * 3) || '}' AS key FROM part)""")
def canonical_keys(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    given = _part(spark, sf_dir).select(k.alias("image_id"), (s * 3).alias("turdsize"), F.when(k % 5 > 0, F.when(s > 25, "flat").otherwise("lines")).alias("mode"), F.when(k % 3 == 0, s).alias("colors"))
    return requests.canonical_key(given, ["image_id"]).select("image_id", "key")


# Whole images; SQL can't express these


def _gray(spark, sf_dir):
    return tables.gray(spark, sf_dir)


@query()
def connected_components(spark, sf_dir):
    ink = _gray(spark, sf_dir).select("image_id", "y", "x", (F.col("v") < 128).cast("int").alias("m"))
    return trace.connected_components(ink, diagonal=True).groupBy("image_id", "region").agg(F.count("*").alias("area"))


@query()
def hysteresis_edges(spark, sf_dir):
    s = stencil.sobel(_gray(spark, sf_dir)).select("image_id", "y", "x", F.col("magnitude").alias("v"))
    return trace.hysteresis(s, 40, 120).groupBy("image_id").agg(F.sum("m").alias("edges"))


@query()
def segmented_regions(spark, sf_dir):
    return trace.segment_regions(tables.colour(spark, sf_dir)).groupBy("image_id", "region").agg(F.count("*").alias("area"), F.count_if("core").alias("core"))


@query()
def region_models(spark, sf_dir):
    return trace.fit_regions(tables.colour(spark, sf_dir)).drop("stops")


@query()
def merged_rects(spark, sf_dir):
    return trace.merge_rects(tables.colour(spark, sf_dir)).groupBy("image_id").agg(F.count("*").alias("rects"), F.sum(F.col("w") * F.col("h")).alias("area"))


@query()
def exact_palettes(spark, sf_dir):
    return trace.exact_palettes(tables.colour(spark, sf_dir).withColumn("a", F.lit(255)).withColumns({c: (F.floor(F.col(c) / 64) * 64).cast("int") for c in "rgb"}), 64)


@query()
def trace_auto(spark, sf_dir):
    """Every image in the mode that its facts ask for."""
    return trace.trace_auto(tables.colour(spark, sf_dir))


@query()
def image_palettes(spark, sf_dir):
    return trace.palettes(tables.colour(spark, sf_dir), 6)


@query()
def trace_lines(spark, sf_dir):
    return trace.trace_lines(_gray(spark, sf_dir))


@query()
def trace_flat(spark, sf_dir):
    return trace.trace_flat(tables.colour(spark, sf_dir), 4)


@query()
def trace_pixel(spark, sf_dir):
    return trace.trace_pixel(tables.colour(spark, sf_dir))


@query()
def trace_gradient(spark, sf_dir):
    return trace.trace_gradient(tables.colour(spark, sf_dir))


@query()
def analysed_images(spark, sf_dir):
    return rules.warnings(rules.decide_mode(trace.analyse(tables.colour(spark, sf_dir))))


@query()
def tuned_lines(spark, sf_dir):
    found = trace.tune(_gray(spark, sf_dir), rules.stage_a(spark)).withColumn("corners", F.round(F.col("corner_share") * F.col("nodes")))
    return rules.best_result(found, F.lit(0.0))


# Documents and sinks

RECTS_SQL = "q AS (SELECT p_partkey // 20 AS image_id, p_partkey AS seq, p_size % 4 AS colour, p_size AS x, CAST(p_partkey % 20 AS INTEGER) AS y, 1 + p_partkey % 3 AS w, 1 + p_size % 2 AS h FROM part)"


def made_up_rects(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return _part(spark, sf_dir).select(F.floor(k / 20).alias("image_id"), k.alias("seq"), (s % 4).alias("colour"), s.alias("x"), (k % 20).cast("int").alias("y"), (1 + k % 3).alias("w"), (1 + s % 2).alias("h"))


MOVES_SQL = "v AS (SELECT *, x - coalesce(lag(x) OVER z, 0) AS dx, y - coalesce(lag(y) OVER z, 0) AS dy FROM q WINDOW z AS (PARTITION BY image_id, colour ORDER BY seq)), d AS (SELECT image_id, colour, count(*) AS rects, string_agg('m' || dx || ' ' || dy || 'h' || w || 'v' || h || 'h-' || w || 'z', '' ORDER BY seq) AS d FROM v GROUP BY image_id, colour)"


@query(f"WITH {RECTS_SQL}, {MOVES_SQL} SELECT image_id, colour, rects, d FROM d")
def rect_path_data(spark, sf_dir):
    return vector.rect_paths(made_up_rects(spark, sf_dir))


@query(f"""WITH {RECTS_SQL}, {MOVES_SQL} SELECT image_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 60 20" width="60" height="20">' || chr(10) ||
  string_agg('  <path fill="#00000' || colour || '"' || CASE WHEN rects > 1 THEN ' fill-rule="evenodd"' ELSE '' END || ' d="' || d || '"/>', chr(10) ORDER BY colour) || chr(10) || '</svg>' || chr(10) AS svg FROM d GROUP BY image_id""")
def svg_documents(spark, sf_dir):
    paths = vector.rect_paths(made_up_rects(spark, sf_dir))
    return vector.svg_document(paths.select("image_id", F.col("colour").alias("rank"), "d", F.concat(F.lit("#00000"), "colour").alias("fill"), F.lit(60).alias("width"), F.lit(20).alias("height")))


@query(f"""WITH {RECTS_SQL} SELECT image_id, '#00000' || colour AS fill, count(*) AS moves, 3 * count(*) AS lines, count(*) AS closes, CAST(min(x) AS DOUBLE) AS x0, CAST(min(y) AS DOUBLE) AS y0, CAST(max(x + w) AS DOUBLE) AS x1, CAST(max(y + h) AS DOUBLE) AS y1 FROM q GROUP BY image_id, colour""")
def svg_read_back(spark, sf_dir):
    """The documents of svg_documents, parsed again: their paths, segments counted in the text, and the segments' bounds."""
    paths = svg.paths_of(svg_documents(spark, sf_dir))
    s = svg.segments_of(paths).groupBy("image_id", "path").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    counts = svg.counts_of(paths).select("image_id", "path", *(F.col(c).cast("long").alias(c) for c in ("moves", "lines", "closes")))
    return paths.select("image_id", "path", "fill").join(counts, ["image_id", "path"]).join(s, ["image_id", "path"]).drop("path")


@query("""WITH q AS (SELECT p_partkey, p_size / 8e0 AS x, (p_partkey % 13) / 2e0 AS y FROM part), t AS (SELECT p_partkey, least(1, sqrt((x - 3) ** 2 + (y - 2) ** 2) / 5e0) AS t FROM q)
SELECT p_partkey, round(t, 6) AS t, round(CASE WHEN t < 0.5e0 THEN 200 * t ELSE 100 + 300 * (t - 0.5e0) END, 6) AS r FROM t""")
def radial_colours(spark, sf_dir):
    rows = [(0.0, 0.0), (0.5, 100.0), (0.5, 7.0), (0.5, 100.0), (1.0, 250.0)]  # the middle one of three at one offset goes
    stops = vector.normalised_stops(F.array(*(F.struct(F.lit(o).alias("offset"), F.lit(v).alias("r"), F.lit(v).alias("g"), F.lit(v).alias("b")) for o, v in rows)))
    x, y = F.col("p_size") / F.lit(8.0), (F.col("p_partkey") % 13) / F.lit(2.0)
    q = _part(spark, sf_dir).select("p_partkey", vector.radial_t(x, y, F.lit(3.0), F.lit(2.0), F.lit(5.0)).alias("t"), stops.alias("stops"))
    return q.where(~vector.degenerate_radial(F.lit(5.0), F.col("stops"))).select("p_partkey", r("t").alias("t"), r(vector.stop_colour(F.col("t"), F.col("stops"), "r")).alias("r"))


@query()
def painted_checkerboards(spark, sf_dir):
    board = synth.chessboard(10, 12)
    marked = board.copy()
    marked[40:80, 40:80] = (200, 20, 90, 255)
    px = images.from_array(spark, board, "board").unionByName(images.from_array(spark, marked, "marked")).unionByName(images.from_array(spark, synth.circle(), "circle"))
    return checker.detect(px)


@query()
def searched_parameters(spark, sf_dir):
    return trace.search(_gray(spark, sf_dir), rules.stage_a(spark))


# Backgrounds

BACK_SQL = """s AS (SELECT image_id, max(x) AS w, max(y) AS hh, avg(CAST(a < 8 AS INTEGER)) AS open FROM colour GROUP BY image_id),
h AS (SELECT image_id, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS key, count(*) AS n, CAST(sum(r) AS DOUBLE) AS sr, CAST(sum(g) AS DOUBLE) AS sg, CAST(sum(b) AS DOUBLE) AS sb FROM colour JOIN s USING (image_id) WHERE a >= 128 AND (x = 0 OR y = 0 OR x = w OR y = hh) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, key) AS k, sum(n) OVER (PARTITION BY image_id) AS tot FROM h),
back AS (SELECT s.image_id, open, CASE WHEN open <= 0.05e0 THEN coalesce(CAST(floor(sr / n + 0.5e0) AS INTEGER), 255) END AS r, CASE WHEN open <= 0.05e0 THEN coalesce(CAST(floor(sg / n + 0.5e0) AS INTEGER), 255) END AS g, CASE WHEN open <= 0.05e0 THEN coalesce(CAST(floor(sb / n + 0.5e0) AS INTEGER), 255) END AS b
  FROM s LEFT JOIN top t ON t.image_id = s.image_id AND k = 1 AND n / tot >= 0.8e0)"""


def half_open(spark, sf_dir):
    """Images of even number made opaque."""
    return tables.colour(spark, sf_dir).withColumn("a", F.when(F.col("image_id") % 2 == 0, 255).otherwise(F.col("a")))


HALF_SQL = COLOUR_SQL.replace("least(255, CAST(round(l_tax * 100) AS INTEGER) * 36) AS a", "CASE WHEN image_id % 2 = 0 THEN 255 ELSE least(255, CAST(round(l_tax * 100) AS INTEGER) * 36) END AS a").replace("0 AS a", "CASE WHEN image_id % 2 = 0 THEN 255 ELSE 0 END AS a")


@query(f"WITH {HALF_SQL}, {BACK_SQL} SELECT image_id, r, g, b, CASE WHEN open > 0.05e0 THEN 'mask' ELSE 'composite' END AS alpha_mode FROM back")
def resolved_backgrounds(spark, sf_dir):
    px = half_open(spark, sf_dir)
    return colour.resolve_background(px).join(colour.resolve_alpha_mode(px), "image_id")


@query(f"""WITH {HALF_SQL}, {BACK_SQL} SELECT image_id, {', '.join(f"CAST(sum(CASE WHEN a = 255 THEN p.{c} WHEN a = 0 THEN coalesce(k.{c}, 255) ELSE (p.{c} * a + coalesce(k.{c}, 255) * (255 - a) + 127) // 255 END) AS BIGINT) AS {c}" for c in 'rgb')} FROM colour p JOIN back k USING (image_id) GROUP BY image_id""")
def on_background(spark, sf_dir):
    px = half_open(spark, sf_dir)
    out = colour.on_background(px, colour.resolve_background(px))
    return out.groupBy("image_id").agg(*(F.sum(c).cast("long").alias(c) for c in "rgb"))
