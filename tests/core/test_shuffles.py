"""How often rows are dealt on their way from pixels to measures, and that what is dealt once stays whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import generate, measures, raster, resize

PALETTE = [(1, 0, 0, 255), (2, 255, 0, 0), (3, 90, 200, 40), (4, 250, 250, 250)]


@pytest.fixture
def joins(spark):
    """Tables as small as these are otherwise broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def inputs(spark, n=5):
    """Images of some sizes; the fourth has no pixels, some pixels lack a channel, and one row of each kind has no image."""
    rng = np.random.default_rng(3)
    size = [(3 + i % 3, 4 + i % 2) for i in range(n)]
    rows = [(i, w, h, 0.5, 0.0, float(w), float(h)) for i, (w, h) in enumerate(size)]
    frames = spark.createDataFrame([*rows, (None, 4, 4, 0.0, 0.0, 4.0, 4.0)], "image_id long, width int, height int, cx double, cy double, cw double, ch double")
    pixels = [(i, x, y, *(None if rng.random() < 0.05 else int(v) for v in rng.integers(0, 256, 3)), int(rng.choice([255, 60]))) for i, (w, h) in enumerate(size) if i != 3 for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame([*pixels, (None, 0, 0, 1, 2, 3, 255), (0, None, 0, 9, 9, 9, 255)], "image_id long, x int, y int, r int, g int, b int, a int")
    return frames, pixels, spark.createDataFrame(PALETTE, "ord int, r int, g int, b int")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (*raster.CELL, *columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("method", ["nearest", "bilinear", "area"])
def test_sums_of_cells_are_dealt_once_by_frame(spark, joins, method):
    frames, pixels, _ = inputs(spark)
    asked = frames.withColumns({"tw": F.lit(4), "th": F.lit(3), "method": F.lit(method)})
    out = resize.resized(asked, pixels)
    # Pixels, frames, sums; none more for what streams through an image's cells.
    assert exchanges(out.repartition("image_id").sortWithinPartitions("image_id", "y", "x")) == 3
    # Each image by itself; twice the rows make the same cells, and frames without an image or without pixels are background.
    assert out.count() == 6 * 12
    twice = resize.resized(asked.union(asked), pixels.union(pixels))
    alone = [r for i in range(5) for r in rows(resize.resized(asked.where(f"image_id = {i}"), pixels.where(f"image_id = {i}")), "active", *"rgb")]
    assert rows(out.where("image_id is not null"), "active", *"rgb") == sorted(alone, key=str) == rows(twice.where("image_id is not null"), "active", *"rgb")
    assert {r[4:] for r in rows(out.where("image_id is null or image_id = 3"), "active", *"rgb")} == {resize.WHITE}


def test_one_style_keeps_the_order_of_rasters(spark, joins, monkeypatch):
    settled, keep = [], generate._settled
    monkeypatch.setattr(generate, "_settled", lambda df: (settled.append(df), keep(df))[-1])
    frames, pixels, palette = inputs(spark)
    cells, measured = generate.candidates(frames, pixels, palette, generate.Options(((4, 3), (2, 2)), max_colors=3, baseline="a0"))
    plan = settled[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Sort [") == 3  # a join's two, and one of cells
    assert measured.count() == 10 and cells.groupBy("image_id").count().count() == 10


def test_measures_of_dealt_cells_need_no_shuffle(spark):
    cells = spark.createDataFrame([(i, x, y, 1 + (i + x * y) % 4, (9 * x, i, y), (x, 7 * y, i)) for i in range(9) for y in range(3) for x in range(1 + i % 4)], "image_id long, x int, y int, ord int, plan struct<r: int, g: int, b: int>, source struct<r: int, g: int, b: int>")
    colors = raster.palette_rows(spark.createDataFrame(PALETTE, "ord int, r int, g int, b int"))
    dealt = measures.measured(cells.coalesce(1), colors, dealt=True)
    assert exchanges(dealt) == 0
    assert sorted(dealt.collect()) == sorted(measures.measured(cells, colors).collect())


def test_a_candidates_fit_goes_ahead_of_its_cells(spark):
    rng = np.random.default_rng(8)
    colors = raster.palette_rows(spark.createDataFrame(PALETTE, "ord int, r int, g int, b int"))
    seen = spark.createDataFrame([(i, x, y, *map(int, rng.integers(0, 256, 3))) for i in (-1, 0, 2) for x in range(5) for y in range(4)], "image_id long, x int, y int, r int, g int, b int")
    fits = {(i, 4 * i + k): (k % 2, 0, 2 + k // 2, 3, i % 2, 0, 9, 7) for i in (-1, 0, 1, 2) for k in range(4)}  # the third image has no reference
    made = [(*key, x, y, int(rng.integers(1, 5))) for key, f in fits.items() if key[1] % 4 != 2 or key[0] for x in range(f[0], f[0] + f[2]) for y in range(3) if rng.random() < 0.9]
    names = ("fx", "fy", "fw", "fh", "rx", "ry", "rw", "rh")
    cells = spark.createDataFrame(made, "image_id long, candidate long, x int, y int, ord int")
    ahead = spark.createDataFrame([(*key, *f) for key, f in fits.items()], f"image_id long, candidate long, {', '.join(f'{n} int' for n in names)}")
    expected = sorted(measures.beside_reference(seen, cells.join(ahead, ["image_id", "candidate"]), colors).collect())
    assert len(expected) == 11 and len({r.distance for r in expected}) > 5
    for more in (ahead, ahead.union(ahead)):
        assert sorted(measures.beside_reference(seen, cells.unionByName(more, allowMissingColumns=True), colors).collect()) == expected


def test_candidates_cells_meet_their_reference_without_a_join(spark, joins, monkeypatch):
    asked, beside = [], measures.beside_reference
    monkeypatch.setattr(measures, "beside_reference", lambda reference, cells, colors: (asked.append(cells), beside(reference, cells, colors))[-1])
    frames, pixels, palette = inputs(spark)
    cells, measured = generate.candidates(frames, pixels, palette, generate.Options(((4, 3), (2, 2)), max_colors=3, baseline="a0"))
    assert exchanges(asked[0]) == 0 and "Join" not in asked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert asked[0].where("ord is not null").count() == cells.count()
    assert measured.where("reference is not null").count() == 10  # an image without pixels is background, its reference too
