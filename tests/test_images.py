"""Synthetic images with known shapes through operators, kernels and plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import formats, numeric, params
from pixelmill.operators import checker, colour, histogram, kernels, masks, metrics, palette, pointwise, resample, stencil, vector
from pixelmill.plans import rules, trace
from pixelmill.sources import images, svg, synth
from pixelmill.streaming import requests


def pixels(spark, *named):
    out = None
    for name, img in named:
        df = images.from_array(spark, img, name)
        out = df if out is None else out.unionByName(df)
    return out.withColumn("a", F.coalesce("a", F.lit(255)))


def one(df):
    return df.collect()[0]


# Numbers


def test_rounding_rules(spark):
    v = spark.createDataFrame([(-1.5,), (-0.5,), (0.5,), (1.5,), (2.5,), (300.0,)], "v double")
    assert [r[0] for r in v.select(numeric.half_up("v")).collect()] == [-1, 0, 1, 2, 3, 300]
    assert [r[0] for r in v.select(numeric.store_u8("v")).collect()] == [0, 0, 0, 2, 2, 255]
    assert svg.format_number(0.1235) == "0.123" and svg.format_number(0.125, 2) == "0.13" and svg.format_number(-0.0001) == "0" and svg.format_number(10) == "10"
    with pytest.raises(ValueError):
        svg.format_number(math.inf)


def test_prng_and_hash_are_32_bit(spark):
    nxt = synth.mulberry32(1)
    assert all(0 <= nxt() < 1 for _ in range(100))
    assert one(spark.createDataFrame([("a",)], "s string").select(numeric.fnv1a("s").alias("h"))).h == 0xE40C292C


# Sources


def test_image_files_round_trip(spark, tmp_path):
    import struct
    import zlib

    def png(a):
        h, w = a.shape[:2]
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + a[y].astype(np.uint8).tobytes() for y in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    a = synth.sprite(16, 3)
    (tmp_path / "s.png").write_bytes(png(a))
    got = np.zeros_like(a)
    for p in images.read_images(spark, f"file://{tmp_path}").collect():
        got[p.y, p.x] = (p.r, p.g, p.b, p.a)
    seen = a[..., 3] > 0
    assert (got[seen] == a[seen]).all() and (got[~seen][:, 3] == 0).all()
    assert [r.kind for r in images.read_files(spark, f"file://{tmp_path}").collect()] == ["png"]


def test_buffers_of_a_wrong_length_are_left_out(spark):
    df = spark.createDataFrame([("a", 1, 1, bytearray(4)), ("b", 1, 1, bytearray(3))], "image_id string, width int, height int, data binary")
    assert [r.image_id for r in images.from_buffers(df).collect()] == ["a"]
    assert images.constant(spark, 3, 2, (1, 2, 3, 4)).count() == 6


def test_size_limits(spark):
    df = spark.createDataFrame([(0, 5), (5000, 5), (5, 5)], "w int, h int")
    assert [r[0] for r in df.select(formats.dimension_error(F.col("w"), F.col("h"))).collect()] == ["empty", "too large", None]


# Paths as text


def test_path_data():
    p = svg.parse_path("M10 10h5v5H2zl1 1")
    assert [s[0] for s in p] == ["M", "L", "L", "L", "Z", "M", "L"] and p[-1][-2:] == (11.0, 11.0)
    assert svg.parse_path("m.5.5 1 1")[1] == ("L", None, None, None, None, 1.5, 1.5)
    c = svg.parse_path("M0 0C0 1 1 1 1 0S2 -1 2 0")
    assert c[2][1:3] == (1.0, -1.0)
    q = svg.parse_path("M0 0q1 1 2 0t2 0")
    assert q[2][1:3] == (3.0, -1.0)
    assert svg.parse_path("M1e1 1E-1") == [("M", None, None, None, None, 10.0, 0.1)]
    with pytest.raises(ValueError):
        svg.parse_path("M0 0A1 1 0 0 0 2 2")
    assert svg.serialise_path(svg.parse_path("M0 0L1 1L2 0.5Z")) == "M0 0L1 1 2 0.5Z"


def test_svg_paths_and_transforms():
    text = '<svg xmlns="http://www.w3.org/2000/svg"><defs><path d="M9 9"/></defs><g fill="#123456" transform="translate(0,10) scale(0.1,-0.1)"><path d="M0 0"/><path transform="translate(5,0)" fill="red" d="M1 1"/></g></svg>'
    a, b = svg.extract_paths(text)
    assert a["fill"] == "#123456" and b["fill"] == "red"
    assert svg.apply_transform(svg.parse_path("M50 20"), svg.parse_transform(a["transform"]))[0][-2:] == pytest.approx((5, 8))
    assert svg.parse_transform(b["transform"])[2] == pytest.approx(0.5)


# Operators on fixtures


def test_facts_of_fixtures(spark):
    px = pixels(spark, ("three", synth.three_shapes()), ("circle", synth.circle()))
    border = {r.image_id: numeric_hex(r) for r in colour.border_mode_colour(px).collect()}
    assert border == {"three": "#f2e8d5", "circle": "#ffffff"}
    ink = {r.image_id: numeric_hex(r) for r in colour.dominant_ink_colour(px.where("image_id = 'circle'"), (255, 255, 255)).collect()}
    assert ink == {"circle": "#000000"}
    assert {r.image_id: r.grid for r in resample.detect_grid(px).collect()} == {"three": 1, "circle": 1}
    bimodal = {r.image_id: r.bimodal for r in histogram.bimodality(histogram.histogram256(pointwise.to_gray(px))).collect()}
    assert bimodal["circle"]
    hard = one(stencil.hard_edge_share(pointwise.to_gray(px.where("image_id = 'circle'")))).hard
    assert hard < 0.5
    mask = pointwise.binarise(pointwise.to_gray(px.where("image_id = 'circle'")), 0.5).select("image_id", "y", "x", "m")
    assert 0.05 < one(stencil.thin_stroke_share(mask)).thin < 0.2


def numeric_hex(r):
    return f"#{r.r:02x}{r.g:02x}{r.b:02x}"


def test_grid_of_an_enlarged_sprite(spark):
    px = pixels(spark, ("s", synth.replicate(synth.sprite(), 3)))
    assert one(resample.detect_grid(px)).grid == 3
    assert one(histogram.alpha_shares(px)).transparent > 0.3


def test_masks_nest_and_layers_cover(spark):
    px = pixels(spark, ("three", synth.three_shapes()))
    labels = pointwise.assign_labels(px, [(0xF2, 0xE8, 0xD5), (0x2A, 0x6F, 0x97), (0xE0, 0x7A, 0x5F)])
    ranks = masks.ranked(labels, masks.layer_order(labels))
    nested = masks.nested_masks(ranks)
    assert nested.where("layer = 0").count() == 96 * 96
    for j in (0, 1):
        assert nested.where(F.col("layer") == j + 1).join(nested.where(F.col("layer") == j), ["image_id", "y", "x"], "left_anti").count() == 0


def test_similarity_of_equal_images(spark):
    g = pointwise.to_gray(pixels(spark, ("g", synth.glyph())))
    p = metrics.paired(g, g)
    assert one(metrics.ssim(p)).ssim == pytest.approx(1) and one(metrics.mean_absolute_error(p)).mae == 0
    assert metrics.same_sizes(g, g).count() == 0 and metrics.same_sizes(g, pointwise.downscale_nearest(g, 2)).count() == 2


def test_relational_blur_and_enlargement_equal_the_kernels(spark):
    img = synth.noisy(synth.three_shapes(24), 9)
    g = pointwise.to_gray(pixels(spark, ("n", img)))
    gray = np.zeros((24, 24))
    for r in g.collect():
        gray[r.y, r.x] = r.v
    for df, want in ((resample.gaussian_blur(g, 0.8), kernels.blur(gray, 0.8)), (resample.upscale(g, 2), kernels.enlarge(gray, 2))):
        rows = df.collect()
        assert len(rows) == want.size and max(abs(r.v - want[r.y, r.x]) for r in rows) < 1e-4
    sob = {(r.y, r.x): r.magnitude for r in stencil.sobel(g).collect()}
    assert max(abs(sob[y, x] - v) for (y, x), v in np.ndenumerate(kernels.sobel(gray))) < 1e-4


def test_relational_coverage_equals_the_kernel(spark):
    t = np.linspace(0, 2 * np.pi, 12, endpoint=False)
    star = np.stack([9 + (4 + 3 * (np.arange(12) % 2)) * np.cos(t), 8 + (4 + 3 * (np.arange(12) % 2)) * np.sin(t)], 1)
    edges = [("s", *map(float, (*a, *b))) for a, b in zip(star, np.roll(star, -1, 0))]
    got = vector.coverage(spark.createDataFrame(edges, "image_id string, x1 double, y1 double, x2 double, y2 double"))
    want = kernels.rasterise([star], 20, 20)
    found = np.zeros((20, 20))
    for r in got.collect():
        found[r.y, r.x] = r.coverage
    assert np.allclose(found, want) and want.sum() == pytest.approx(kernels.area(star), rel=0.02)


# Kernels


def brute_components(m, eight):
    out, n = np.full(m.shape, -1), 0
    for y, x in zip(*np.nonzero(m)):
        if out[y, x] >= 0:
            continue
        todo = [(y, x)]
        out[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (eight or not dy or not dx) and 0 <= a + dy < m.shape[0] and 0 <= b + dx < m.shape[1] and m[a + dy, b + dx] and out[a + dy, b + dx] < 0:
                        out[a + dy, b + dx] = n
                        todo.append((a + dy, b + dx))
        n += 1
    return out


def test_components_equal_flood_fill():
    rng = np.random.default_rng(1)
    for p in (0.3, 0.5, 0.7):
        m = rng.random((23, 31)) < p
        assert (kernels.components(m) == brute_components(m, False)).all()
        assert (kernels.components(m, steps=kernels.EIGHT) == brute_components(m, True)).all()


def test_hysteresis_keeps_what_touches_strong_pixels():
    v = np.random.default_rng(2).random((20, 20)) * 100
    piece, want = brute_components(v > 60, True), np.zeros((20, 20), bool)
    for i in np.unique(piece[(v > 95)]):
        want |= piece == i
    assert (kernels.hysteresis(v, 60, 95) == want).all()


def test_rectangles_cover_once():
    a = synth.sprite(32, 7)
    seen = np.zeros((32, 32), int)
    for x, y, w, h, c in kernels.merge_rects(a):
        seen[y: y + h, x: x + w] += 1
        assert (a[y: y + h, x: x + w] == [c >> 24, c >> 16 & 255, c >> 8 & 255, c & 255]).all()
    assert (seen == (a[..., 3] > 0)).all()


def test_gradient_models_find_the_truth():
    ramp = synth.linear_panel()[..., :3]
    regions, core, _ = kernels.segment(ramp)
    ys, xs = np.nonzero((regions == regions[64, 64]) & core)
    m = kernels.fit_region(ramp, ys, xs)
    assert m["kind"] == "linear" and abs(m["y2"] - m["y1"]) < 0.06 * abs(m["x2"] - m["x1"]) and m["rmse"] < 2
    disc = synth.radial_disc()[..., :3]
    regions, core, _ = kernels.segment(disc)
    ys, xs = np.nonzero((regions == regions[66, 60]) & core)
    m = kernels.fit_region(disc, ys, xs)
    assert m["kind"] == "radial" and math.hypot(m["cx"] - 60, m["cy"] - 66) < 2 and abs(m["r"] - 48) < 0.05 * 48 + 2


def test_traced_shapes_cover_their_masks():
    for img, least in ((synth.circle(256, 80), 0.98), (synth.glyph(192), 0.97), (synth.square(), 0.97)):
        mask = img[..., 0] < 128
        h, w = mask.shape
        paths = kernels.trace(mask)
        c = kernels.rasterise([kernels.flatten(p) for p in paths], w, h)
        assert np.minimum(c, mask).sum() / np.maximum(c, mask).sum() > least
        assert (kernels.trace(mask) == paths)
    circle = kernels.trace(synth.circle(256, 80)[..., 0] < 128)[0]
    kinds = [s[0] for s in circle]
    assert kinds.count("L") / (kinds.count("L") + kinds.count("C")) < 0.15


# Plans


def test_traces_of_fixtures(spark):
    lines = one(trace.trace_lines(pixels(spark, ("circle", synth.circle()))))
    assert lines.iou > 0.95 and lines.corner_share < 0.15 and lines.fidelity > 0.95
    assert len(svg.extract_paths(lines.svg)) == 1
    flat = one(trace.trace_flat(pixels(spark, ("three", synth.three_shapes())), 6))
    assert flat.layers >= 3 and flat.fidelity > 0.95
    a = synth.sprite()
    pixel = one(trace.trace_pixel(pixels(spark, ("s", synth.replicate(a, 3)))))
    drawn = np.zeros((32, 32, 3))
    for p in svg.extract_paths(pixel.svg):
        rgb = [int(p["fill"][i: i + 2], 16) for i in (1, 3, 5)]
        mask = kernels.rasterise([kernels.flatten(x) for x in split(svg.parse_path(p["d"]))], 32, 32) > 0.5
        drawn[mask] = rgb
    seen = a[..., 3] > 0
    assert (drawn[seen] == a[seen][:, :3]).all()
    gradient = one(trace.trace_gradient(pixels(spark, ("g", synth.linear_panel()))))
    assert gradient.fidelity > 0.95 and "linearGradient" in gradient.svg


def split(segments):
    out = []
    for s in segments:
        if s[0] == "M":
            out.append([])
        out[-1].append(s)
    return out


def test_modes_of_fixtures(spark):
    px = pixels(spark, ("sprite", synth.replicate(synth.sprite(), 3)), ("circle", synth.circle()), ("three", synth.three_shapes()))
    decided = {r.image_id: r.mode for r in rules.decide_mode(trace.analyse(px)).collect()}
    assert decided == {"sprite": "pixel", "circle": "lines", "three": "flat"}


def test_tuning_picks_the_best_candidate(spark):
    g = pointwise.to_gray(pixels(spark, ("glyph", synth.glyph())))
    found = trace.tune(g, rules.stage_a(spark).where("seq < 6")).withColumn("corners", F.round(F.col("corner_share") * F.col("nodes")))
    rows = found.collect()
    best = one(rules.best_result(found, F.lit(0.0)))
    assert best.score == max(r.score for r in rows) and len(rows) == 6
    seeds = rules.pick_seeds(found.withColumn("key", F.col("seq").cast("string")).withColumn("eligible", F.lit(True)), 2)
    assert sorted(r.place for r in seeds.collect()) == [1, 2]
    assert rules.early_exit(found.withColumn("score", F.lit(1.0)).withColumn("corner_share", F.lit(0.0))).count() == 1


def test_parameters(spark):
    df = spark.createDataFrame([("a", 300, 300, float("nan"), None), ("b", 2000, 9000, 5.0, "pixel")], "image_id string, width int, height int, blur_k double, mode string")
    a, b = params.resolve(df).orderBy("image_id").collect()
    assert (a.mode, a.blur_k, a.upscale, a.engine) == ("lines", 0.35, 4, "potrace") and (b.mode, b.blur_k, b.upscale, b.sigma) == ("pixel", 1.0, 1, 0.0)


def test_requests(spark):
    rows = [("s", 1, "trace", "trace", "p"), ("s", 2, "trace", "trace", "p"), ("s", 3, "tune", "setSource", "x"), ("s", 4, "trace", "trace", "p")]
    df = spark.createDataFrame(rows, "session string, id long, channel string, kind string, payload string")
    assert {r.id: r.superseded for r in requests.latest_wins(df).collect()} == {1: True, 2: True, 3: False, 4: False}
    assert {r.id: r.hit for r in requests.replay(df).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_request_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "trace", "trace", "p"), ("s", 2, "trace", "trace", "q")], "session string, id long, channel string, kind string, payload string").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = requests.latest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert [r.id for r in spark.sql("SELECT * FROM latest").collect()] == [2]


def test_painted_checkerboards(spark):
    board = synth.chessboard(10, 12)
    logo = board.copy()
    logo[40:80, 40:80] = (200, 20, 90, 255)
    px = pixels(spark, ("board", board), ("logo", logo), ("circle", synth.circle()), ("three", synth.three_shapes()))
    found = {r.image_id: r for r in checker.detect(px).collect()}
    assert set(found) == {"board", "logo"}
    assert all(abs(r.cell - 12) <= 0.25 and r.match > 0.95 and (r.low, r.high) == (204, 255) for r in found.values())
    left = checker.remove(px.where("image_id = 'logo'"), checker.detect(px)).where("a > 0")
    assert 1500 <= left.count() <= 1700


def test_merging_regions():
    a = np.full((40, 40, 3), 100.0)
    a[:, 20:] = 101
    a[5, 5] = 250
    a[20:, :] += np.array([60, 0, 0])
    merged = kernels.merge_regions(a, np.unique(a.reshape(-1, 3), axis=0, return_inverse=True)[1].reshape(40, 40))
    assert len(np.unique(merged)) == 2 and merged[0, 0] == merged[0, 39] != merged[39, 0]


def test_search_ends_no_worse_than_the_first_stage(spark):
    g = pointwise.to_gray(pixels(spark, ("glyph", synth.glyph(32)), ("square", synth.square(32, 12))))
    first = rules.stage_a(spark).where("seq < 4")
    start = {r.image_id: r.score for r in trace.tune(g, first.where("seq = 0")).collect()}
    found = {r.image_id: r for r in trace.search(g, first, 1).collect()}
    assert set(found) == set(start) and all(found[i].score >= start[i] - 1e-9 for i in start)


def test_segment_counts():
    assert svg.count_segments("M0 0 1 1h2v3C1 2 3 4 5 6 7 8 9 1 2 3Zq1 1 2 2") == {"M": 1, "L": 3, "C": 2, "Q": 1, "Z": 1}


def test_order_of_regions():
    r = np.zeros((20, 20), int)
    r[:, 12:] = 1
    r[4:9, 2:9] = 2
    r[5:8, 4:7] = 3
    order = kernels.region_order(r)
    assert sorted(order) == [0, 1, 2, 3] and order.index(0) < order.index(2) < order.index(3) and order[0] == 0


def test_complex_regions_are_split():
    a = np.full((40, 40, 3), 60.0)
    y, x = np.mgrid[:40, :40]
    a[(x - 20) ** 2 + (y - 20) ** 2 < 120] = (200, 40, 90)
    parts = kernels.split_regions(a, np.zeros((40, 40), int))
    assert len(np.unique(parts)) == 2 and parts[20, 20] != parts[0, 0]
    assert len(np.unique(kernels.split_regions(np.full((20, 20, 3), 9.0), np.zeros((20, 20), int)))) == 1


# Palettes, modes, alpha


def opaque(rgb):
    rgb = np.asarray(rgb, float)
    rgb = np.repeat(rgb[..., None], 3, 2) if rgb.ndim == 2 else rgb
    return np.concatenate([np.clip(np.floor(rgb + 0.5), 0, 255), np.full((*rgb.shape[:2], 1), 255.0)], -1)


def test_exact_palette_has_the_real_colours_and_no_blends():
    found, n = palette.exact(synth.three_shapes().astype(float) if synth.three_shapes().shape[2] == 4 else opaque(synth.three_shapes()))
    assert {tuple(int(v) for v in c) for c in found} == {(0xF2, 0xE8, 0xD5), (0x2A, 0x6F, 0x97), (0xE0, 0x7A, 0x5F)} and n.sum() > 0.95 * 96 * 96
    assert palette.exact(np.zeros((8, 8, 4)))[0].shape == (0, 3)
    many = opaque(np.kron(np.random.default_rng(0).permutation(64)[:, None] // [16, 4, 1] % 4 * 80, np.ones((1, 1))).reshape(8, 8, 3).repeat(8, 0).repeat(8, 1))
    assert palette.exact(many) is None and len(palette.exact(many, 64)[0]) == 64


def test_noise_is_no_line_drawing_and_a_noisy_scan_is_one(spark):
    rng = np.random.default_rng(1)
    noise = opaque(rng.normal(128, 25, (96, 96)))
    ink = np.zeros((96, 96))
    ink[20:70, 30:60] = 1
    scan = opaque(np.where(ink[..., None] > 0, (60, 40, 30), (215, 200, 170)) + rng.uniform(-30, 30, (96, 96, 3)))
    ramp = np.clip(np.stack([np.add.outer(np.arange(96), np.arange(96)) * 1.3] * 3, -1) + rng.uniform(-40, 40, (96, 96, 3)), 0, 255)
    px = pixels(spark, ("noise", noise), ("scan", scan), ("ramp", opaque(ramp)))
    facts = trace.analyse(px)
    got = {r.image_id: r for r in rules.warnings(rules.decide_mode(facts)).collect()}
    assert got["noise"].colours == 1 and got["noise"].off_palette > 0.5 and got["noise"].mode != "lines"
    assert got["scan"].colours is None and got["scan"].bimodal and got["scan"].two_tone_off < 0.1 and got["scan"].reason == "two tones"
    assert got["ramp"].reason != "two tones"


def test_two_tones_need_two_colours_that_cover_the_image(spark):
    base = dict(width=500, height=500, grid=1, hard_edges=0.0, transparent=0.0, colours=None, off_palette=0.9, two_tone_off=0.4, bimodal=True, thin=0.6, explained=0.0, gradient_share=0.0, edge_share=1.0, regions=1)
    rows = [("a", base), ("b", base | {"two_tone_off": 0.51}), ("c", base | {"transparent": 0.06}), ("d", base | {"bimodal": False}), ("e", base | {"colours": 2, "off_palette": 0.2}), ("f", base | {"width": 5000, "height": 5000})]
    schema = "image_id string, width int, height int, grid int, hard_edges double, transparent double, colours int, off_palette double, two_tone_off double, bimodal boolean, thin double, explained double, gradient_share double, edge_share double, regions int"
    df = spark.createDataFrame([(i, *v.values()) for i, v in rows], schema)
    got = {r.image_id: (r.reason, r.warnings) for r in rules.warnings(rules.decide_mode(df)).collect()}
    assert got["a"] == ("two tones", ["thin-strokes"]) and got["b"] == got["c"] == got["d"] == ("photo", ["photo"])
    assert got["e"] == ("few colours", ["thin-strokes"]) and got["f"][1] == ["thin-strokes", "large-input"]


def test_transparent_images_keep_their_transparency(spark):
    y, x = np.mgrid[:64, :64]
    disc = np.zeros((64, 64, 4))
    disc[...] = (0, 200, 0, 0)  # a hidden colour
    disc[(y - 32) ** 2 + (x - 32) ** 2 < 400] = (200, 30, 60, 255)
    disc[(y - 32) ** 2 + (x - 32) ** 2 < 80] = (20, 30, 160, 255)
    px = pixels(spark, ("disc", disc))
    flat = one(trace.trace_flat(px, None))
    assert flat.layers == 2 and "#c81e3c" in flat.svg and "#141ea0" in flat.svg and "#00c800" not in flat.svg and flat.fidelity > 0.95
    lines = one(trace.trace_lines(px))
    assert lines.iou > 0.8 and 'fill="#c81e3c"' in lines.svg
    gradient = one(trace.trace_gradient(px))
    assert "#00c800" not in gradient.svg and gradient.layers == 2 and gradient.fidelity > 0.95
    empty = disc.copy()
    empty[..., 3] = 0
    assert one(trace.trace_lines(pixels(spark, ("empty", empty)))).warnings == []
    white = np.full((32, 32, 4), 255.0)
    white[..., 3] = 200 + 55 * (x[:32, :32] > 20)
    assert one(trace.trace_lines(pixels(spark, ("white", white)))).warnings == ["empty-trace"]


def test_each_image_is_traced_in_its_own_mode(spark):
    sprite = synth.replicate(synth.sprite(16, 3), 3)
    px = pixels(spark, ("circle", synth.circle()), ("sprite", sprite), ("three", synth.three_shapes()))
    got = {r.image_id: r for r in trace.trace_auto(px).collect()}
    assert got["circle"].mode == "lines" and got["sprite"].mode == "pixel" and got["three"].mode == "flat" and all(r.fidelity > 0.9 for r in got.values())
    assert got["three"].layers == 3


def test_pixel_mode_is_scored_by_what_it_draws(spark):
    half = synth.replicate(synth.sprite(16, 3), 2)
    assert one(trace.trace_pixel(pixels(spark, ("s", half)))).fidelity == 1.0
    noise = opaque(np.random.default_rng(2).integers(0, 255, (110, 110, 3)))
    assert one(trace.trace_pixel(pixels(spark, ("n", noise)))).warnings == ["too-many-rects"]


def test_foreign_pixels_are_far_from_their_region_inside_it():
    rgb = np.full((20, 20, 3), 100.0)
    rgb[9, 8] = 255
    rgb[9, 9] = 255  # too near to the other region
    rgb[0, 5] = 255
    regions = np.zeros((20, 20), int)
    regions[:, 12:] = 1
    models = {0: {"color": [100, 100, 100], "kind": "solid"}, 1: {"color": [10, 10, 10], "kind": "solid"}}
    seen = np.ones((20, 20), bool)
    assert trace.foreign_pixels(rgb, regions, models, seen, 48) == {0: 2, 1: 20 * (8 - 3)}


def test_stencils_over_images_of_different_sizes(spark):
    rng = np.random.default_rng(3)
    images_ = {"a": rng.integers(0, 255, (7, 4)), "b": rng.integers(0, 255, (5, 3)), "c": rng.integers(0, 255, (1, 6))}
    g = spark.createDataFrame([(n, y, x, int(v[y, x])) for n, v in images_.items() for y in range(v.shape[0]) for x in range(v.shape[1])], "image_id string, y int, x int, v int").repartition(3)
    got = {(r.image_id, r.y, r.x): r.magnitude for r in stencil.sobel(g).collect()}
    for n, v in images_.items():
        want = kernels.sobel(v)
        assert all(abs(got[n, y, x] - want[y, x]) < 1e-9 for y in range(v.shape[0]) for x in range(v.shape[1])), n
    edges = {r.image_id: r.perimeter for r in stencil.perimeter(g.select("image_id", "y", "x", (F.col("v") < 128).cast("int").alias("m"))).collect()}
    for n, v in images_.items():
        m = v < 128
        assert abs(edges[n] - math.pi / 4 * ((m[1:] != m[:-1]).sum() + (m[:, 1:] != m[:, :-1]).sum())) < 1e-9


def test_a_worker_serves_in_line_and_cancels_jump_the_queue(spark):
    rows = [
        ("a", 1, "trace", None, 0.0, 5.0), ("a", 2, "setSource", None, 0.0, 1.0), ("a", 3, "trace", None, 0.0, 5.0), ("a", 4, "tune", None, 1.0, 5.0), ("a", 5, "classify", None, 1.0, 1.0),
        ("a", 6, "cancel", 4, 2.0, 0.0), ("a", 7, "trace", None, 7.0, 4.0), ("a", 8, "cancel", 7, 9.0, 0.0), ("a", 9, "compare", None, 8.0, 1.0), ("a", 10, "cancel", 9, 99.0, 0.0), ("a", 11, "what", None, 20.0, 1.0), ("b", 12, "init", None, 3.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "session string, id long, kind string, target long, at double, takes double")
    got = {r.id: (r.response, r.began, r.ended) for r in requests.serve(df).collect()}
    assert got == {
        1: ("error", 0, 0), 2: ("sourceSet", 0, 1), 3: ("traced", 1, 6), 4: ("cancelled", 2, 2), 5: ("classified", 6, 7), 7: ("cancelled", 7, 9), 9: ("compared", 9, 10), 11: ("error", 20, 20), 12: ("ready", 3, 4),
    }
    assert {r[0] for r in got.values()} <= set(requests.RESPONSES) and {r[2] for r in rows} - {"what"} <= set(requests.REQUESTS)
