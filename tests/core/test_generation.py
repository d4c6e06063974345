"""Generation as a stream: its steps in memory against the operators that they stand for, and how few shuffles of cells it needs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.operators import cleanup, generate, planning, raster, relaxation, resize

PALETTE = [(k, k * 53 % 256, k * 97 % 256, k * 193 % 256) for k in range(1, 9)]
OPTIONS = generate.Options(((4, 5), (6, 6)), max_colors=5)


def inputs(spark, n=6):
    rng = np.random.default_rng(5)
    size = [(5 + i % 3, 4 + i % 4) for i in range(n)]
    frames = spark.createDataFrame([(i, w, h, -0.5 + i % 2, 0.0, w - 0.75 * (i % 3), float(h)) for i, (w, h) in enumerate(size)], "image_id long, width int, height int, cx double, cy double, cw double, ch double")
    pixels = [(i, x, y, *(int(v) // 64 * 64 for v in rng.integers(0, 256, 3)), int(rng.choice([255, 255, 90]))) for i, (w, h) in enumerate(size) for y in range(h) for x in range(w)]
    marks = [(i, f"eye-{s}", "eye", 1 + s, 1, 1.0 if i % 3 else 0.4, "hard" if i % 2 else "soft", i % 2, "eyes") for i in range(n) for s in range(2)]
    return (
        frames,
        spark.createDataFrame(pixels, "image_id long, x int, y int, r int, g int, b int, a int"),
        spark.createDataFrame(PALETTE, "ord int, r int, g int, b int"),
        spark.createDataFrame(marks, "image_id long, landmark_id string, kind string, x int, y int, confidence double, priority string, grid_radius int, symmetry_group string"),
    )


def rows(df, *columns):
    return {(r.image_id, r.x, r.y): tuple(r[c] for c in columns) for r in df.collect()}


def test_cells_of_candidates_are_dealt_once_and_equal_the_operators(spark, monkeypatch):
    frames, pixels, palette, marks = inputs(spark)
    settled, keep = [], generate._settled
    monkeypatch.setattr(generate, "_settled", lambda df: (settled.append(df), keep(df))[-1])
    cells, measured = generate.candidates(frames, pixels, palette, OPTIONS, marks)
    plan = settled[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "FlatMapGroups" not in plan
    assert plan.count("Join") <= 8  # of pixels, frames, landmarks and rasters; none of candidates' cells
    got = rows(cells, "ord")
    # The same candidates by the operators, one after the other.
    sizes, styles = sorted(OPTIONS.sizes, key=lambda s: s[0] * s[1]), OPTIONS.styles
    canvas = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("tw"), F.lit(h).alias("th")) for k, (w, h) in enumerate(sizes))))
    numbered = frames.select("*", canvas.alias("s")).select("*", "s.tw", "s.th", F.lit("area").alias("method"), F.col("image_id").alias("own"), (F.col("image_id") * 2 + F.col("s.k")).alias("number")).drop("s")
    numbered = numbered.withColumn("image_id", F.col("number"))
    spread = pixels.join(numbered.select("own", "number"), pixels["image_id"] == F.col("own")).select(F.col("number").alias("image_id"), "x", "y", *"rgba")
    made = resize.resized(numbered.drop("own"), spread).where("active")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), color.styled(*map(F.col, "rgb"), s).alias("c")) for k, s in enumerate(styles))))
    styled = made.select("image_id", "x", "y", each.alias("s")).select((F.col("image_id") * 3 + F.col("s.k")).alias("image_id"), "x", "y", "s.c.*").checkpoint()
    simple = F.col("image_id") % 3 == styles.index("simple")
    levelled = raster.value_levels(styled.where(~simple), 3).union(raster.value_levels(styled.where(simple), 2))
    placed = generate._placed(marks, resize.fitted(numbered), 3).checkpoint()
    weighed = levelled.join(planning.importance_weights(levelled.select("image_id", "x", "y", F.lit(0.0).alias("importance")), placed), raster.CELL).checkpoint()
    colors = raster.palette_rows(palette)
    limit = F.element_at(F.array(*(F.lit(color.style_color_limit(5, s)) for s in styles)), (F.col("image_id") % 3 + 1).cast("int"))
    chosen = raster.greedy_order(weighed, colors, 5, "delta-e-2000").select("image_id", F.slice("ords", 1, limit).alias("chosen")).checkpoint()
    known = weighed.withColumn("lab", color.lab(*map(F.col, "rgb"))).join(chosen, "image_id")
    held = generate.features.protected_cells(placed, weighed).withColumn("protected", F.lit(True)).checkpoint()
    start = known.drop("lab").join(raster.nearest(known, colors, "delta-e-2000"), raster.CELL).join(held, raster.CELL, "left").withColumnRenamed("weight", "importance")
    expected = rows(cleanup.final_grid(cleanup.cleaned(relaxation.relaxed(start, colors), held)), "ord")
    assert got == expected and len({k[0] for k in got}) == 6 * 2 * 3
    assert measured.count() == 36


def test_clean_up_in_memory_equals_the_frames(spark):
    rng = np.random.default_rng(6)
    grids = rng.choice([-1, 0, 1, 1, 1, 2], (40, 5, 6))
    grids[:, [0, 4], :] = np.maximum(0, grids[:, [0, 4], :])
    grids[:, :, [0, 5]] = np.maximum(0, grids[:, :, [0, 5]])
    held = (rng.random(grids.shape) < 0.1) & (grids >= 0)
    places = [(i, x, y) for i, y, x in zip(*map(np.ndarray.tolist, np.nonzero(grids >= 0)), strict=True)]
    cells = spark.createDataFrame([(i, x, y, int(grids[i, y, x])) for i, x, y in places], "image_id long, x int, y int, ord int")
    marks = spark.createDataFrame([(i, x, y) for i, x, y in places if held[i, y, x]], "image_id long, x int, y int")
    for penalties in (cleanup.Penalties(), cleanup.Penalties(least_region=4, isolated=2.0, stripe=0.4), cleanup.Penalties(stripe=0.0, alias=0.0)):
        frame = rows(cleanup.final_grid(cleanup.cleaned(cells, marks, penalties)), "ord")
        out = cleanup.cleaned_grids(grids, held, penalties)
        assert frame == {(i, x, y): (out[i, y, x],) for i, x, y in places}


def test_levels_and_colours_in_memory_equal_the_columns(spark):
    rng = np.random.default_rng(7)
    made = [(i, k, 0, *map(int, rng.integers(0, 4, 3) * 60)) for i in range(8) for k in range(1 + 9 * (i % 3))]
    pixels = spark.createDataFrame(made, "image_id long, x int, y int, r int, g int, b int")
    rgb, image = np.array([m[3:] for m in made]), np.array([m[0] for m in made])
    for n in (2, 3):
        out = raster.levelled(image, rgb, np.full(len(rgb), n))
        assert rows(raster.value_levels(pixels, n), *"rgb") == {m[:3]: tuple(o) for m, o in zip(made, out.tolist(), strict=True)}
    columns = [color.lab(*map(F.col, "rgb")).alias("lab"), *(color.styled(*map(F.col, "rgb"), s).alias(s) for s in ("cute", "simple", "high-contrast"))]
    told = {(r.image_id, r.x, r.y): r for r in pixels.select("image_id", "x", "y", *columns).collect()}
    lab, styled = color.lab_rows(rgb), {s: color.styled_rows(rgb, s) for s in ("cute", "simple", "high-contrast")}
    for k, m in enumerate(made):
        assert tuple(told[m[:3]].lab) == pytest.approx(tuple(lab[k]), abs=1e-9)
        assert all(tuple(told[m[:3]][s]) == tuple(styled[s][k]) for s in styled)


def test_an_image_without_pixels_is_background(spark):
    frames, pixels, _, _ = inputs(spark, 2)
    asked = frames.withColumns({"tw": F.lit(3), "th": F.lit(4), "method": F.lit("bilinear")})
    out = rows(resize.resized(asked, pixels.where("image_id = 0")), "r", "g", "b", "active")
    assert len(out) == 2 * 12 and {v[:3] for k, v in out.items() if k[0] == 1} == {(255, 255, 255)} and any(v[3] for k, v in out.items() if k[0] == 1)
