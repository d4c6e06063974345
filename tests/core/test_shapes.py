"""Shape variants against full recomputation, by hand, and across calls of a stored table."""

import time

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tessella.operators import kernels, shapes, subjects


def plain_search(active, coverage, distance, protected, components, holes, sweeps):
    """Every flip judged by the energy of the whole mask."""
    active, flips = active.copy(), 0
    band = shapes.boundary_band(active) | ((coverage > 0.05) & (coverage < 0.95)) | (np.abs(distance) <= 1.5)
    now = shapes.energy(active, coverage, distance, components, holes)
    for _ in range(sweeps):
        before = flips
        for y, x in zip(*np.nonzero(band & ~protected), strict=True):
            active[y, x] ^= True
            turned = shapes.energy(active, coverage, distance, components, holes)
            if turned + 1e-9 < now:
                now, flips = turned, flips + 1
            else:
                active[y, x] ^= True
        if flips == before:
            break
    return active, flips


def test_search_equals_full_recomputation():
    rng = np.random.default_rng(1)
    for _ in range(150):
        shape = rng.integers(1, 10, 2)
        coverage, distance = np.clip(rng.normal(0.5, 0.4, shape), 0, 1), rng.normal(0, 1.5, shape)
        active, protected = (coverage >= 0.5) ^ (rng.random(shape) < 0.1), rng.random(shape) < 0.1
        wanted = int(rng.integers(0, 4)), int(rng.integers(0, 3))
        got, flips = shapes.refined(active, coverage, distance, protected, *wanted, 3)
        want, plain_flips = plain_search(active, coverage, distance, protected, *wanted, 3)
        assert (got == want).all() and flips == plain_flips
        assert (got == active)[protected].all()
        assert shapes.energy(got, coverage, distance, *wanted) <= shapes.energy(active, coverage, distance, *wanted)


def test_changes_of_single_flips_and_simple_cells():
    rng = np.random.default_rng(2)
    for _ in range(150):
        shape = rng.integers(1, 8, 2)
        coverage, distance, active = rng.random(shape), rng.normal(0, 1.5, shape), rng.random(shape) < 0.5
        changes = shapes.flip_changes(active, coverage, distance)
        assert shapes.topology(active) == (len(kernels.labelled(active)), kernels.hole_count(active))
        for y, x in np.ndindex(*shape):
            flipped = active.copy()
            flipped[y, x] ^= True
            as_is = lambda m: shapes.energy(m, coverage, distance, *shapes.topology(m))
            assert abs(as_is(flipped) - as_is(active) - changes[y, x]) < 1e-9
            assert not shapes.simple(active, y, x) or shapes.topology(active) == shapes.topology(flipped)


def test_overlaps_are_shares_of_cells():
    for start, length, cells in ((0, 8, 6), (1.5, 4.25, 3), (0, 8, 20), (2, 1, 1)):
        shares = shapes.overlaps(start, length, cells, 8)
        assert np.allclose(shares.sum(axis=1), 1) and (shares >= 0).all()
        fine = np.floor(start + (np.arange(cells * 3000) + 0.5) * length / cells / 3000).reshape(cells, 3000)
        assert np.allclose(shares, [[(row == k).mean() for k in range(8)] for row in fine], atol=1e-3)


def test_distances_are_exact():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (1, 9), (12, 7), (30, 31)):
        on = rng.random(shape) < 0.3
        got = shapes.signed_distances(on)
        y, x = np.mgrid[: shape[0], : shape[1]]
        for r, c in np.ndindex(*shape):
            other = on != on[r, c]
            far = np.sqrt(((y - r) ** 2 + (x - c) ** 2)[other].min()) if other.any() else np.sqrt(shape[0] ** 2 + shape[1] ** 2 + 1)
            assert np.isclose(abs(got[r, c]), far, rtol=1e-6) and (got[r, c] > 0) == on[r, c]


def test_a_mask_of_512_is_quick():
    y, x = np.mgrid[:512, :512] - 256
    values = np.clip((200 - np.hypot(y, x) + 20 * np.sin(np.arctan2(y, x) * 9)) / 3, 0, 1)
    start = time.perf_counter()
    asked = {"image_id": 1, "key": "k", "crop": {"x": 0.0, "y": 0.0, "width": 512.0, "height": 512.0}, "fit": {"x": 0, "y": 0, "width": 96, "height": 96}, "width": 96, "height": 96, "sweeps": 2, "marks": None}
    row = shapes.variant(values, shapes.signed_distances(values >= 0.5), asked)
    assert time.perf_counter() - start < 5
    assert row["energy_after"] <= row["energy_before"] and row["components"] == row["reference_components"] == 1


VARIANT = "image_id long, cx double, cy double, cw double, ch double, width int, height int, sweeps int"


def ring(spark, images=(1,)):
    """A ring of 6 x 6 pixels in an image of 10 x 10."""
    on = {(x, y) for x in range(2, 8) for y in range(2, 8)} - {(x, y) for x in range(4, 6) for y in range(4, 6)}
    rows = [(i, x, y, float((x, y) in on)) for i in images for x in range(10) for y in range(10)] + [(9, x, 0, 0.2) for x in range(5)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, v double")


def test_stored_variants_are_made_once(spark, tmp_path):
    table = shapes.ShapeVariants(spark, str(tmp_path / "variants"))
    masks = ring(spark, (1, 2))
    asked = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 10, 10, 2), (1, 0.0, 0.0, 10.0, 10.0, 10, 10, 2), (2, 0.0, 0.0, 10.0, 10.0, 5, 5, 2), (9, 0.0, 0.0, 5.0, 1.0, 5, 1, 0), (None, 0.0, 0.0, 5.0, 1.0, 5, 1, 0)], VARIANT)
    first = sorted(map(str, table.get(masks, asked).collect()))
    assert len(first) == 2 and table.made.value == 2  # image 9 has no foreground
    assert sorted(map(str, table.get(masks, asked).collect())) == first and table.made.value == 2
    more = asked.union(spark.createDataFrame([(2, 0.0, 0.0, 10.0, 10.0, 8, 8, 2)], VARIANT))
    assert table.get(masks, more).count() == 3 and table.made.value == 3
    assert table.get(masks, asked).count() == 2 and table.stored().count() == 3
    other = asked.limit(1).selectExpr("*", "'r2' AS revision")  # another revision of the mask is another variant
    assert table.get(masks, other).count() == 1 and table.made.value == 4


def test_a_ring_keeps_its_hole_and_scores(spark):
    made = shapes.rasterised(ring(spark), shapes.keyed(spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 10, 10, 2)], VARIANT)))
    row = made.first()
    assert (row.reference_components, row.components, row.reference_holes, row.holes) == (1, 1, 1, 1)
    cells = {(r.x, r.y): r.active for r in shapes.variant_cells(made).collect()}
    assert sum(cells.values()) == 32 - row.edits and len(cells) == 100 or row.edits
    score = shapes.shape_scores(made).first()
    assert score.topology == 1 and 0.8 < score.structure <= 1


def test_landmarks_hold_their_discs(spark):
    marks = spark.createDataFrame(
        [(1, "far", 0.0, 0.0, 1.0, "hard", 1.0, True), (1, "soft", 9.0, 9.0, 1.0, "soft", 1.0, True), (1, "unsure", 9.0, 0.0, 1.0, "hard", 0.4, True), (1, "none", 0.0, 9.0, 1.0, "hard", 1.0, False), (1, "outside", 30.0, 9.0, 1.0, "hard", 1.0, True)],
        "image_id long, landmark_id string, x double, y double, grid_radius double, priority string, confidence double, affects_occupancy boolean",
    )
    made = shapes.rasterised(ring(spark), shapes.keyed(spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 10, 10, 2)], VARIANT)), marks)
    row = made.first()
    assert [tuple(a) for a in row.allocated] == [("far", 0, 0, 3)]
    cells = {(r.x, r.y): r for r in shapes.variant_cells(made).collect()}
    assert {q for q, r in cells.items() if r.protected} == {(0, 0), (1, 0), (0, 1)} and all(cells[q].active for q in ((0, 0), (1, 0), (0, 1)))


@pytest.mark.parametrize("wrong", [(0.0, 0.0, 0.0, 5.0, 5, 5, 0), (0.0, 0.0, 5.0, 5.0, 0, 5, 0), (0.0, 0.0, 5.0, 5.0, 5, 5, 33), (0.0, 0.0, float("nan"), 5.0, 5, 5, 0), (0.0, None, 5.0, 5.0, 5, 5, 0)])
def test_wrong_variants_fail(spark, wrong):
    with pytest.raises(PySparkException, match="a variant needs"):
        shapes.keyed(spark.createDataFrame([(1, *wrong)], VARIANT)).collect()


def test_models_of_masks(spark):
    got = {r.image_id: r for r in shapes.shape_models(ring(spark)).collect()}
    assert (got[1].area, got[1].holes, [tuple(c) for c in got[1].components]) == (32, 1, [(32, 2, 2, 6, 6, False)])
    assert (got[9].area, got[9].holes, got[9].components) == (0, 0, [])


def test_a_winding_path_is_flooded_whole(spark):
    side = 41  # a spiral of ground, one pixel wide, from the corner to the middle
    ground, (x, y), (dx, dy) = {(0, 0)}, (0, 0), (1, 0)
    while True:
        for _ in range(2):
            if 0 <= x + dx < side and 0 <= y + dy < side and (x + dx, y + dy) not in ground and (x + 2 * dx, y + 2 * dy) not in ground:
                break
            dx, dy = -dy, dx
        else:
            break
        x, y = x + dx, y + dy
        ground.add((x, y))
    rows = [(1, x, y, *((255,) * 3 if (x, y) in ground else (0, 0, 0) if 0 < x < side - 1 and 0 < y < side - 1 else (255,) * 3), 255) for x in range(side) for y in range(side)]
    got = {(r.x, r.y): r.v for r in subjects.inferred(spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")).collect()}
    assert all(got[q] == 0 for q in ground) and len(ground) > 400
    assert {got[x, y] for x in range(1, side - 1) for y in range(1, side - 1) if (x, y) not in ground} == {1.0}
