"""Queries take every image of their rasters."""

import os

from pyspark.sql import functions as F

from pixelmill.plans import more_queries, rules, trace  # noqa: F401
from pixelmill.plans.queries import QUERIES
from pixelmill.sources import tables

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def ids(df):
    return sorted(r.image_id for r in df.select("image_id").distinct().collect())


def test_gated_sobel_takes_every_image(spark):
    every = ids(tables.colour(spark, SF_DIR))
    assert ids(QUERIES["gated_sobel"](spark, SF_DIR)) == every and len(every) > 1


def test_blur_and_upscale_take_every_image(spark):
    every = ids(tables.gray(spark, SF_DIR))
    assert len(every) > 2
    for name in ("gaussian_blur", "bicubic_upscale_2x"):
        assert ids(QUERIES[name](spark, SF_DIR)) == every, name


def test_nearest_and_grid_take_every_image(spark):
    every = ids(tables.gray(spark, SF_DIR))
    assert len(every) > 4
    for name in ("upscale_nearest", "detect_grid"):
        assert ids(QUERIES[name](spark, SF_DIR)) == every, name


def test_searches_are_given_every_image_the_whole_grid_and_three_seeds(spark, monkeypatch):
    given = []
    tune = trace.tune

    def noted(raster, candidates):
        given.append((ids(raster), candidates.count()))
        return tune(raster.limit(0), candidates)

    def searched(raster, first, seeds=3, guard=0.005):
        given.append((ids(raster), first.count(), seeds))
        return raster

    monkeypatch.setattr(trace, "tune", noted)
    monkeypatch.setattr(trace, "search", searched)
    QUERIES["tuned_lines"](spark, SF_DIR)
    QUERIES["searched_parameters"](spark, SF_DIR)
    every, grid = ids(tables.gray(spark, SF_DIR)), rules.stage_a(spark).count()
    assert given == [(every, grid), (every, grid, 3)] and grid == 36


def test_trace_flat_is_given_whole_rasters(spark, monkeypatch):
    monkeypatch.setattr(trace, "trace_flat", lambda pixels, colours: pixels)
    assert QUERIES["trace_flat"](spark, SF_DIR).count() == tables.colour(spark, SF_DIR).count()


def test_components_label_whole_images(spark, tmp_path):
    rows = [(f"t{k % 2}", k * k % 64, k * 7 % 24) for k in range(4000) if k % 3] + [("t0", y, 3) for y in range(12, 40)] * 90
    events = spark.createDataFrame(rows, "event_type string, user_id long, h int").selectExpr("event_type", "user_id", "make_timestamp(2024, 1, 1, h, 0, 0) AS ts")
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    d = tables.density(spark, f"file://{tmp_path}")
    middle = d.agg(F.median("v")).first()[0]
    ink = {(r.image_id, r.y, r.x) for r in d.collect() if r.v >= middle + 1}
    want, left = {}, set(ink)
    while left:
        todo = [left.pop()]
        name = todo[0][0]
        pieces, n = want.get(name, (0, 0))
        while todo:
            i, y, x = todo.pop()
            n += 1
            for p in ((i, y - 1, x), (i, y + 1, x), (i, y, x - 1), (i, y, x + 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        want[name] = (pieces + 1, n)
    assert any(y >= 16 for _, y, _ in ink) and max(p for p, _ in want.values()) > 1
    assert {r.image_id: (r.pieces, r.ink) for r in QUERIES["components_small"](spark, f"file://{tmp_path}").collect()} == want


def test_polygons_and_numbers_equal_the_slow_way(monkeypatch):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    import numpy as np

    from pixelmill.operators import kernels
    from pixelmill.sources.svg import format_number

    rng = np.random.default_rng(5)
    masks = [kernels.blur(rng.random((40, 50)), s) > 0.5 for s in (0.0, 0.8, 2.0)]
    quick = [kernels.trace(m, 1.0, 2, 0.6) for m in masks]
    monkeypatch.setattr(kernels, "FEW", 0)
    assert quick == [kernels.trace(m, 1.0, 2, 0.6) for m in masks]
    for c in kernels.contours(masks[1]):
        x, y = c.T
        assert kernels.area(c) == float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2)
    r = random.Random(2)
    for n in [0.0625, -0.0625, 2.5, -0.0, -0.0001, 7, 1e12 + 0.5, *(r.randrange(-9999, 9999) / 2 ** r.randrange(9) for _ in range(500)), *(r.uniform(-300, 300) for _ in range(500))]:
        for places in (0, 2, 3):
            exact = Decimal(n).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
            text = format_number(n, places)
            assert Decimal(text) == exact and text != "-0" and not (("." in text) and text.endswith("0"))


def test_candidates_are_tried_on_whole_images_of_any_size():
    import numpy as np

    a = np.full((8, 300, 1), 255.0)
    a[2:6, 3:290:5] = 0  # strokes one pixel wide, lost where the image is reduced
    a[2:6, 4:290:9] = 40
    c = {"seq": 0, "upscale": 2, "blur_k": 0.0, "alphamax": 1.0, "turdsize": 1, "opttolerance": 0.2}
    got, want = trace._tried(a, [c]).iloc[0], trace._Lines(a).trace(0.0, 1.0, 1, 0.2, 2).iloc[0]
    columns = ["paths", "nodes", "corner_share", "ssim", "iou", "fidelity", "score"]
    assert got[columns].tolist() == want[columns].tolist() and got["paths"] >= 50


def test_curves_of_many_masks_equal_those_of_one_border_at_a_time():
    import numpy as np

    from pixelmill.operators import curves, kernels
    from pixelmill.sources.svg import format_number, format_numbers, serialise_path

    rng = np.random.default_rng(7)
    masks = np.stack([kernels.blur(rng.random((33, 47)), s) > t for s, t in ((0.0, 0.5), (0.8, 0.5), (2.0, 0.5), (0.7, 0.4), (0.0, 1.0), (0.0, -1.0))])
    h, w = masks.shape[1:]
    for alphamax, turdsize, tolerance in ((1.0, 2, 0.6), (0.6, 0, 0.5), (1.334, 16, 0.8)):
        got = curves.trace(masks, alphamax, turdsize, tolerance)
        want = [kernels.trace(m, alphamax, turdsize, tolerance) for m in masks]
        assert got.data(len(masks)) == ["".join(map(serialise_path, p)) for p in want] and len(got.count) == sum(map(len, want)) > 9
        kinds = [s[0] for paths in want for p in paths for s in p]
        assert (got.lines, got.bends) == (kinds.count("L"), kinds.count("C"))
        drawn = curves.coverage(got, len(masks), w // 2 + 1, h // 2 + 1, 2)
        for cover, paths in zip(drawn, want):
            assert np.array_equal(cover, kernels.rasterise([p / 2 for p in kernels.flatten_all(paths)], w // 2 + 1, h // 2 + 1, 8))
    borders = curves.borders(masks)
    slow = [(m, c) for m in range(len(masks)) for c in kernels.contours(masks[m])]
    assert borders.mask.tolist() == [m for m, _ in slow] and borders.area.tolist() == [kernels.area(c) for _, c in slow]
    assert np.array_equal(np.column_stack([borders.x, borders.y]), np.concatenate([c for _, c in slow]))
    numbers = np.concatenate([[0.0, -0.0, 0.0005, -0.0004, -0.0625, 4096.0, 123456.0625, 1e9, 5e12], rng.integers(-99999, 99999, 2000) / 2.0 ** rng.integers(0, 12, 2000), rng.uniform(-5000, 5000, 2000)])
    assert format_numbers(numbers) == [format_number(v) for v in numbers.tolist()]


def test_no_trace_goes_border_by_border(monkeypatch):
    import numpy as np

    from pixelmill.operators import kernels

    monkeypatch.setattr(kernels, "polygon", None)
    monkeypatch.setattr(kernels, "smooth", None)
    a = np.append(np.random.default_rng(3).integers(0, 256, (19, 32, 3)), np.full((19, 32, 1), 255), -1).astype(float)
    for found in (trace._gradient_image(a, 1.0, 1.0, 2, 0.2), trace._flat_image(a, 16, 0.35, 1.0, 2, 0.2), trace._Lines(a).trace(0.35, 1.0, 2, 0.2)):
        assert found["nodes"].iloc[0] >= 3 and "<path" in found["svg"].iloc[0]


def test_images_of_a_windowed_raster_are_dealt_to_more_tasks_than_their_bytes_ask_for(spark):
    dealt = trace.dealt(tables.colour(spark, SF_DIR), list("rgba"))
    assert dealt.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt.groupBy("image_id").count().count() == len(ids(dealt)) == 10


def test_facts_count_colours_without_sorting_rows(monkeypatch):
    import numpy as np

    from pixelmill.operators import palette

    rng = np.random.default_rng(2)
    for colours in (rng.integers(0, 256, (400, 3)).astype(float), rng.integers(-2, 300, (50, 3)), rng.integers(0, 9, (90, 3)) / 2, np.zeros((0, 3))):
        found, n = palette.tally(colours)
        want, m = np.unique(colours, axis=0, return_counts=True)
        assert np.array_equal(found, want) and np.array_equal(n, m) and found.dtype == want.dtype
    a = np.append(rng.integers(0, 256, (19, 32, 3)), np.full((19, 32, 1), 255), -1).astype(float)
    want, unique = trace.facts(a), np.unique

    def numbers_only(values, *rest, axis=None, **more):
        assert axis is None
        return unique(values, *rest, **more)

    monkeypatch.setattr(palette.np, "unique", numbers_only)
    assert trace.facts(a) == want


def test_search_tries_each_image_once_with_the_results_of_its_stages(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, y, x, int(v)) for i in (1, 2, 3) for (y, x), v in np.ndenumerate(rng.integers(0, 256, (12, 16)))]
    raster = spark.createDataFrame(rows, "image_id int, y int, x int, v int")
    first, corners = rules.stage_a(spark).where("seq % 5 = 0"), F.round(F.col("corner_share") * F.col("nodes"))
    a = trace.tune(raster, first).withColumn("corners", corners).join(first, "seq")
    floor = a.where("seq = 0").select("image_id", (F.col("fidelity") - 0.005).alias("floor"))
    a = a.join(floor, "image_id").withColumn("eligible", F.col("fidelity") >= F.col("floor")).withColumn("key", rules.evaluation_key())
    best = rules.pick_seeds(a, 3).select(F.struct("image_id", F.col("place").alias("seq")).alias("seq"), "upscale", "blur_k", "alphamax", "turdsize")
    fine = rules.stage_b(best).select(F.col("seed.image_id").alias("image_id"), (1000 * F.col("seed.seq") + F.col("seq")).cast("int").alias("seq"), "upscale", "blur_k", "alphamax", "turdsize", "opttolerance")
    b = trace.tune_each(raster, fine).withColumn("corners", corners).join(fine, ["image_id", "seq"]).join(floor, "image_id")
    found = trace.search(raster, first)
    want = rules.best_result(a.select(found.columns + ["floor"]).unionByName(b.select(found.columns + ["floor"])), F.col("floor")).drop("floor")
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() == 3
    assert found._jdf.queryExecution().optimizedPlan().toString().count("InPandas") == 1
