"""Steps whose work grew faster than their input: how many rows they make, and that their results stay the same."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import canonical, color
from tessella.operators import generate, measures, raster, shapes
from tessella.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def images(spark, n=3, side=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, x, y, *map(int, rng.integers(0, 256, 3))) for i in range(n) for y in range(side) for x in range(side)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int"), {r[:3]: np.array(r[3:]) for r in rows}


PALETTE = [(1, 0, 0, 255), (2, 255, 0, 0), (3, 90, 200, 40)]


def test_reference_of_a_small_crop_makes_no_row_for_a_repeated_cell(spark, monkeypatch):
    pixels, _ = images(spark)
    frames = spark.createDataFrame([(i, 4, 4, 1.0, 0.0, 3.0, 4.0) for i in range(3)], "image_id long, width int, height int, cx double, cy double, cw double, ch double")
    options = generate.Options(((3, 3),), max_colors=2, baseline="a0")
    seen, asked, beside = [], [], measures.beside_reference
    monkeypatch.setattr(measures, "beside_reference", lambda reference, cells, colors: (seen.append(reference), asked.append(cells), beside(reference, cells, colors))[-1])
    got = generate.candidates(frames, pixels.withColumn("a", F.lit(255)), spark.createDataFrame(PALETTE, "ord int, r int, g int, b int"), options)[1].collect()
    assert seen[0].count() == 3 * 12  # not the raster's 72 x 96 cells of each image
    # The same candidates beside rasters whose every cell is a row.
    x, y = (F.lit(o) + F.least(F.lit(n - 1), F.floor((F.col(f"g{c}") + 0.5) * n / side)) for c, o, n, side in (("x", 1, 3, 72), ("y", 0, 4, 96)))
    wide = spark.range(72).select(F.col("id").alias("gx")).crossJoin(spark.range(96).select(F.col("id").alias("gy"))).select("gx", "gy", x.alias("x"), y.alias("y"))
    full = wide.join(pixels, ["x", "y"]).select("image_id", F.col("gx").alias("x"), F.col("gy").alias("y"), "r", "g", "b")
    colors = raster.palette_rows(spark.createDataFrame(PALETTE, "ord int, r int, g int, b int"))
    expected = {r.candidate: (r.distance, r.agreement) for r in beside(full, asked[0].drop("rx", "ry", "rw", "rh"), colors).collect()}
    assert {r.candidate: (r.reference, r.reference_edges) for r in got} == {k: pytest.approx(v) for k, v in expected.items()}


@pytest.mark.parametrize(("source", "target", "side"), [(4, 3, 12), (4, 4, 3), (4, 6, 10)])
def test_reference_distance_compares_repeated_pairs_once(spark, monkeypatch, source, target, side):
    pixels, rgb = images(spark, side=source)
    assigned = spark.createDataFrame([(i, x, y, 1 + (i + x * y) % 3) for i in range(3) for x in range(target) for y in range(target)], "image_id long, x int, y int, ord int")
    palette = spark.createDataFrame(PALETTE, "ord int, r int, g int, b int")
    made, mean = [], raster.mean_color_distance
    monkeypatch.setattr(raster, "mean_color_distance", lambda p, *rest: (made.append(p), mean(p, *rest))[-1])
    got = {r.image_id: r.distance for r in raster.reference_distance(pixels, assigned, palette, source, target, side).collect()}
    assert made[0].count() <= 3 * min(side, source + target - 1) ** 2
    lab = {(r.r, r.g, r.b): np.array(list(r.lab)) for r in pixels.select("r", "g", "b").union(palette.select("r", "g", "b")).select("r", "g", "b", color.lab(*map(F.col, "rgb")).alias("lab")).collect()}
    for i in range(3):
        far = []
        for gx, gy in np.ndindex(side, side):
            at = [min(source - 1, max(0, int(np.floor((g + 0.5) * source / side)))) for g in (gx, gy)]
            cell = [min(target - 1, int((g + 0.5) / side * target)) for g in (gx, gy)]
            own, other = lab[tuple(int(v) for v in rgb[i, *at])], lab[PALETTE[(i + cell[0] * cell[1]) % 3][1:]]
            far.append(color.e2000_matrix(own[None], other[None])[0, 0])
        assert got[i] == pytest.approx(np.mean(far))


@pytest.mark.parametrize(("source", "target"), [(4, 7), (4, 3), (4, 1), (1, 3)])
def test_bilinear_needs_no_join(spark, source, target):
    pixels, rgb = images(spark, side=source)
    out = raster.resize_bilinear(pixels, source, target, ["r", "g", "b"])
    assert "Join" not in plan(out)
    got = {(r.image_id, r.x, r.y): (r.r, r.g, r.b) for r in out.collect()}
    assert len(got) == 3 * target * target
    held = lambda v: max(0, min(source - 1, int(v)))
    for (i, gx, gy), value in got.items():
        (x, fx), (y, fy) = ((np.floor(a), a - np.floor(a)) for a in ((g + 0.5) * source / target - 0.5 for g in (gx, gy)))
        expected = sum(u * v * rgb[i, held(p), held(q)] for p, u in ((x, 1 - fx), (x + 1, fx)) for q, v in ((y, 1 - fy), (y + 1, fy)))
        assert value == pytest.approx(tuple(expected))


def test_scores_of_variants_make_each_once_without_a_join(spark):
    masks = spark.createDataFrame([(i, x, y, float((x - 3) ** 2 + (y - 3) ** 2 < 9 + i)) for i in range(3) for x in range(8) for y in range(8)], "image_id long, x int, y int, v double")
    asked = shapes.keyed(spark.createDataFrame([(i, 0.0, 0.0, 8.0, 8.0, 6, 6, 1) for i in range(3)], "image_id long, cx double, cy double, cw double, ch double, width int, height int, sweeps int"))
    made = shapes.rasterised(masks, asked)
    out = shapes.shape_scores(made)
    assert "Join" not in plan(out) and plan(out).count("FlatMapCoGroupsInArrow") == 1
    got = {r.image_id: r for r in out.collect()}
    for r in made.collect():
        on, cover = np.array(r.active), np.array(r.coverage)
        assert got[r.image_id].occupancy == pytest.approx(on.mean()) and got[r.image_id].coverage_iou == pytest.approx(np.minimum(on, cover).sum() / np.maximum(on, cover).sum())


def test_a_number_is_made_and_written_once(spark):
    made = plan(spark.range(1).select(canonical.number(F.sqrt("id")).alias("j")))
    assert made.count("SQRT(") == 1
    assert made.count("as string") == 2  # the number's and its exponent's


def test_nested_identities_spread_a_small_file(spark, tmp_path):
    rows = [(i, f"na{'\n' * (i % 2)}me {i}", "Brand#1", "SMALL TIN", i, 10.0 ** (i - 10)) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = catalogue.QUERIES["nested_identities"](spark, str(tmp_path))
    assert "RepartitionByExpression [p_partkey" in plan(out)
    found = {r.id: json.loads(r.canonical) for r in out.collect()}
    assert found == {
        i: {"box": {"container": name, "price": price}, "labels": {"brand": brand, "maker": None if i % 4 == 0 else kind}, "odd": i % 2 == 1, "size": size, "words": [["SMALL", 1.25], ["TIN", 0.75]]} for i, name, brand, kind, size, price in rows
    }
