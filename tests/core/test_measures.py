"""Measures of candidates against plain loops, and whole generations of small images."""

import numpy as np
import pytest

from tessella.functions import color
from tessella.operators import generate, measures

LABS = np.array([[50.0, 0.0, 0.0], [60.0, 30.0, -20.0], [70.0, -10.0, 40.0]])
PALETTE = [{"ord": i + 1, "lab": dict(zip(("l", "a", "b"), lab, strict=True))} for i, lab in enumerate(LABS.tolist())]


def plain(labels, labs):
    """(agreement, isolated, stripes) of one grid, cell by cell."""
    height, width = labels.shape
    on = lambda y, x: 0 <= y < height and 0 <= x < width and labels[y, x] >= 0
    agree = pairs = alone = stripes = 0
    for y, x in np.ndindex(height, width):
        if not on(y, x):
            continue
        for dy, dx in ((0, 1), (1, 0)):
            if on(y + dy, x + dx):
                edge = np.sqrt(((labs[y, x] - labs[y + dy, x + dx]) ** 2).sum()) >= 12
                agree += edge == (labels[y, x] != labels[y + dy, x + dx])
                pairs += 1
        sides = [labels[q] if on(*q) else None for q in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x))]
        alone += labels[y, x] not in sides
        left, right, top, bottom = sides
        stripes += None not in sides and ((left == right != labels[y, x]) or (top == bottom != labels[y, x]))
    return (agree / pairs if pairs else 1.0), alone, stripes


def test_edges_and_quality_match_plain_loops():
    rng = np.random.default_rng(1)
    for _ in range(60):
        shape = (3, *rng.integers(1, 8, 2))
        labels, labs = rng.integers(-1, 3, shape), rng.normal(0, 8, (*shape, 3))
        agree = measures.share(*measures.agreement(labs, labels))
        alone, stripes = measures.quality(labels)
        for i in range(3):
            assert plain(labels[i], labs[i]) == pytest.approx((agree[i], alone[i], stripes[i]))


def test_measures_of_candidates_of_many_sizes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, x, y, int(rng.integers(1, 4)), tuple(map(int, rng.integers(0, 256, 3))), tuple(map(int, rng.integers(0, 256, 3)))) for i in range(12) for y in range(i % 4 + 1) for x in range(i % 5 + 1) if (x, y) == (0, 0) or rng.random() < 0.9]
    cells = spark.createDataFrame(rows, "image_id long, x int, y int, ord int, plan struct<r: int, g: int, b: int>, source struct<r: int, g: int, b: int>")
    got = {r.image_id: r for r in measures.measured(cells, PALETTE).collect()}
    assert got.keys() == set(range(12))
    for i, r in got.items():
        own = [x for x in rows if x[0] == i]
        assert (r.cells, r.colors) == (len(own), len({x[3] for x in own}))
        grid = np.full((max(x[2] for x in own) + 1, max(x[1] for x in own) + 1), -1)
        for _, x, y, o, _, _ in own:
            grid[y, x] = o - 1
        _, alone, stripes = plain(grid, np.zeros((*grid.shape, 3)))
        assert (r.isolated, r.stripes) == (alone, stripes)


def test_reference_matches_plain_loops(spark):
    rng = np.random.default_rng(3)
    seen = {(i, x, y): tuple(map(int, rng.integers(0, 256, 3))) for i in range(3) for x in range(9) for y in range(2, 8)}
    reference = spark.createDataFrame([(i, x, y, *c) for (i, x, y), c in seen.items()], "image_id long, x int, y int, r int, g int, b int")
    fit = (1, 0, 3, 4)
    cells = {(i, i * 10 + k, x, y): int(rng.integers(1, 4)) for i in range(3) for k in range(2) for x in range(1, 4) for y in range(4) if rng.random() < 0.8}
    table = spark.createDataFrame([(*key, o, *fit) for key, o in cells.items()], "image_id long, candidate long, x int, y int, ord int, fx int, fy int, fw int, fh int")
    got = {r.candidate: (r.distance, r.agreement) for r in measures.beside_reference(reference, table, PALETTE).collect()}
    lab = lambda c: np.array([spark_lab[c][k] for k in ("l", "a", "b")])
    spark_lab = {(r.r, r.g, r.b): r.lab.asDict() for r in reference.select("r", "g", "b", color.lab(*(reference[c] for c in "rgb")).alias("lab")).collect()}
    for i in range(3):
        for k in range(2):
            labels, labs, far = np.full((6, 9), -1), np.zeros((6, 9, 3)), []
            for x in range(9):
                for y in range(6):
                    labs[y, x] = lab(seen[i, x, y + 2])
                    o = cells.get((i, i * 10 + k, 1 + int((x + 0.5) / 9 * 3), int((y + 0.5) / 6 * 4)))
                    if o:
                        labels[y, x] = o - 1
                        far.append(color.e2000_matrix(labs[y, x][None], LABS)[0, o - 1])
            assert got[i * 10 + k] == pytest.approx((np.mean(far), plain(labels, labs)[0]))


def test_landmarks_are_spared_and_a_hidden_one_rejects(spark):
    frames = spark.createDataFrame([(7, 8, 8, 0.0, 0.0, 8.0, 8.0), (8, 8, 8, 0.0, 0.0, 8.0, 8.0)], "image_id long, width int, height int, cx double, cy double, cw double, ch double")
    pixels = spark.createDataFrame([(7, x, y, *((0, 0, 255) if (x, y) == (4, 4) else (255, 0, 0)), 255) for x in range(8) for y in range(8)], "image_id long, x int, y int, r int, g int, b int, a int")
    palette = spark.createDataFrame([(1, 0, 0, 255), (2, 255, 0, 0)], "ord int, r int, g int, b int")
    eye = spark.createDataFrame([(7, "eye", "eye", 4, 4, 1.0, "hard", 0, None)], "image_id long, landmark_id string, kind string, x int, y int, confidence double, priority string, grid_radius int, symmetry_group string")
    options = generate.Options(((8, 8),), ("faithful",), max_colors=2)
    ords = lambda cells: {(r.x, r.y): r.ord for r in cells.collect()}
    one = frames.where("image_id = 7")
    plain_cells, plain_measures = generate.candidates(one, pixels, palette, options)
    assert set(ords(plain_cells).values()) == {2}  # a single blue cell is smoothed or cleaned away
    cells, measured = generate.candidates(one, pixels, palette, options, eye)
    assert ords(cells)[4, 4] == 1 and sum(o == 1 for o in ords(cells).values()) == 1
    row = measured.first()
    assert row.valid and row.feature > 0 and row.confidence == 1 and row.reference < 1e-6
    status = {r.image_id: (r.nth, r.status) for r in generate.ranked(measured, options, frames).collect()}
    assert status == {7: (1, "success"), 8: (None, "no-valid-candidate")}
    hidden = eye.withColumn("x", eye["x"] - 2)  # a red eye on red ground
    best = generate.ranked(generate.candidates(one, pixels, palette, options, hidden)[1], options).first()
    assert (best.valid, best.status) == (False, "best-effort")
    assert generate.ranked(plain_measures, options).first().status == "success"
