"""Clean-up, smoothing and adaptation against plain versions that go cell by cell, and on grids known from hand."""

import random
from collections import Counter

import numpy as np
import pytest

from tessella.functions import color
from tessella.operators import cleanup, kernels, relaxation

SIDES = ((-1, 0), (1, 0), (0, -1), (0, 1))
RED, BLUE = 2, 1


def plain_cleanup(grid, held, width, height, p):
    """(grid, log) after the three passes, one cell at a time."""
    near = lambda q, to: [(q[0] + dx, q[1] + dy) for dx, dy in to if (q[0] + dx, q[1] + dy) in grid]
    now, log, seen = dict(grid), [], set()
    for cell in sorted(grid, key=lambda q: (q[1], q[0])):
        if cell in seen:
            continue
        part, open_ = {cell}, [cell]
        while open_:
            fresh = [q for q in near(open_.pop(), SIDES) if q not in part and grid[q] == grid[cell]]
            part.update(fresh)
            open_ += fresh
        seen |= part
        votes = Counter(grid[q] for c in part for q in near(c, SIDES) if q not in part)
        if len(part) < p.least_region and not part & held and votes:
            other, n = min(votes.items(), key=lambda v: (-v[1], v[0]))
            if p.isolated * n > len(part):
                log += [(q, grid[q], other, "isolated-cell" if len(part) == 1 else "small-region") for q in sorted(part, key=lambda q: (q[1], q[0]))]
    for q, _, after, _ in log:
        now[q] = after
    inner = [(x, y) for y in range(1, height - 1) for x in range(1, width - 1) if (x, y) in grid and (x, y) not in held]
    before = dict(now)
    for q in inner:
        x, y = q
        if p.stripe > 0 and len(near(q, SIDES)) == 4:
            weights = Counter(before[a] for a, b in (((x - 1, y), (x + 1, y)), ((x, y - 1), (x, y + 1))) if before[a] == before[b] != before[q])
            best = sorted(((n, o) for o, n in weights.items() if p.stripe * n > 0.5), reverse=True)
            if best and (len(best) == 1 or best[0][0] > best[1][0]):
                log.append((q, now[q], best[0][1], "stripe"))
                now[q] = best[0][1]
    before = dict(now)
    for q in inner:
        counts = Counter(before[n] for n in near(q, cleanup.AROUND))
        if p.alias > 0 and counts:
            other, n = min(counts.items(), key=lambda v: (-v[1], v[0]))
            if other != before[q] and n >= 6 and sum(before[s] == before[q] for s in near(q, SIDES)) <= 1 and p.alias * (n - counts[before[q]]) > 1:
                log.append((q, now[q], other, "topology"))
                now[q] = other
    return now, log


def grids(rows):
    out = {}
    for r in rows:
        out.setdefault(r.image_id, {})[r.x, r.y] = r.ord
    return out


@pytest.mark.parametrize("p", [cleanup.Penalties(), cleanup.Penalties(6, 1.0, 0.3, 0.5), cleanup.Penalties(4, 0.6, 0, 1.0), cleanup.Penalties(1, 1, 1, 0)])
def test_cleanup_matches_a_plain_version(spark, p):
    rng = random.Random(5)
    rows, held, sizes = [], [], {}
    for i in range(40):
        width, height, colors = rng.randint(1, 9), rng.randint(1, 9), rng.choice([2, 2, 3])
        sizes[i] = width, height
        for y in range(height):
            for x in range(width):
                if rng.random() < 0.9:  # grids with gaps
                    rows.append((i, x, y, 0 if rng.random() < 0.6 else rng.randrange(colors), width, height))
                held += [(i, x, y)] * (2 if rng.random() < 0.05 else 0)
    cells = spark.createDataFrame(rows, "image_id long, x int, y int, ord int, width int, height int")
    frame = cleanup.cleaned(cells, spark.createDataFrame(held, "image_id long, x int, y int"), p).cache()
    got, logs = grids(cleanup.final_grid(frame).collect()), {}
    for r in sorted(cleanup.edit_log(frame).collect(), key=lambda r: (r.image_id, r.seq)):
        own = logs.setdefault(r.image_id, [])
        assert r.seq == len(own) + 1
        own.append(((r.x, r.y), r.before, r.after, r.reason))
    for i, size in sizes.items():
        grid = {(x, y): o for j, x, y, o, _, _ in rows if j == i}
        now, log = plain_cleanup(grid, {(x, y) for j, x, y in held if j == i}, *size, p)
        assert got.get(i, {}) == now and logs.get(i, []) == log
    frame.unpersist()


def three(spark, middle):
    return spark.createDataFrame([(1, x, y, middle[x] if y == 1 else RED) for y in range(3) for x in range(3)], "image_id long, x int, y int, ord int")


def test_stripe_and_feature_of_three_by_three(spark):
    stripe = three(spark, (RED, BLUE, RED))
    frame = cleanup.cleaned(stripe)
    assert {r.ord for r in cleanup.final_grid(frame).collect()} == {RED}
    assert [tuple(r)[1:] for r in cleanup.edit_log(frame).collect()] == [(1, 1, 1, BLUE, RED, "isolated-cell")]
    assert cleanup.edit_counts(cleanup.edit_log(frame)).first().asDict() == {"image_id": 1, "isolated_cell": 1, "small_region": 0, "stripe": 0, "topology": 0}
    kept = cleanup.cleaned(stripe, spark.createDataFrame([(1, 1, 1)], "image_id long, x int, y int"))
    assert grids(cleanup.final_grid(kept).collect())[1][1, 1] == BLUE and cleanup.edit_log(kept).count() == 0
    assert cleanup.edit_log(cleanup.cleaned(stripe, penalties=cleanup.Penalties(1, 1, 0, 0))).count() == 0
    assert cleanup.final_grid(cleanup.cleaned(stripe.where("x < 0"))).count() == 0


def test_component_ids_are_the_smallest_places():
    rng = np.random.default_rng(3)
    for _ in range(100):
        values = rng.integers(-1, 3, rng.integers(1, 9, 2))
        ids = cleanup.component_ids(values)
        assert ((ids < 0) == (values < 0)).all()
        for v in range(3):
            for part in kernels.labelled(values == v):
                assert (ids[part] == np.flatnonzero(part.ravel())[0]).all()


def plain_sweeps(labels, cost, right, down, free, sweeps):
    labels = labels.copy()
    height, width = labels.shape
    for _ in range(sweeps):
        for y in range(height):
            for x in range(width):
                if not free[y, x]:
                    continue
                own = cost[y, x].copy()
                for dx, dy, w in ((-1, 0, right[y, x - 1] if x else 0), (1, 0, right[y, x] if x + 1 < width else 0), (0, -1, down[y - 1, x] if y else 0), (0, 1, down[y, x] if y + 1 < height else 0)):
                    if 0 <= x + dx < width and 0 <= y + dy < height and labels[y + dy, x + dx] >= 0:
                        own += w
                        own[labels[y + dy, x + dx]] -= w
                labels[y, x] = own.argmin()
    return labels


def test_diagonals_settle_as_raster_order_does_and_energy_never_rises():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, height, width, k = 3, *rng.integers(1, 10, 2), 4
        labels = rng.integers(0, k, (n, height, width))
        labels[rng.random(labels.shape) < 0.1] = -1
        cost = rng.integers(0, 40, (n, height, width, k)).astype(float)  # whole numbers, so that ties are ties
        right, down = rng.integers(0, 12, (n, height, width - 1)).astype(float), rng.integers(0, 12, (n, height - 1, width)).astype(float)
        free = (labels >= 0) & (rng.random(labels.shape) < 0.9)
        got, levels = relaxation.settled(labels, cost, right, down, free, 3)
        for i in range(n):
            assert (got[i] == plain_sweeps(labels[i], cost[i], right[i], down[i], free[i], 3)).all()
        assert (np.diff(levels, axis=1) <= 1e-9).all() and levels.shape == (n, 4)


def palette_of(*colors):
    labs = [{"l": 50.0 + 10 * i, "a": float(a), "b": float(b)} for i, (a, b) in enumerate(colors)]
    return [{"ord": i + 1, "lab": lab} for i, lab in enumerate(labs)]


def test_images_of_many_sizes_stream_whole(spark):
    rng = random.Random(6)
    rows = [(i, x, y, rng.randrange(256), rng.randrange(256), rng.randrange(256), rng.randint(1, 3), rng.random(), rng.random() < 0.1, sorted(rng.sample([1, 2, 3], 2))) for i in range(30) for y in range(i % 5 + 1) for x in range(i % 7 + 1)]
    schema = "image_id long, x int, y int, r int, g int, b int, ord int, importance double, protected boolean, chosen array<int>"
    cells, palette = spark.createDataFrame(rows, schema), palette_of((0, 0), (30, -20), (-10, 40))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # images are cut by batches
    try:
        cut = grids(relaxation.relaxed(cells, palette).collect())
        steps = {}
        for r in relaxation.relaxed(cells, palette, energies=True).collect():
            steps.setdefault(r.image_id, {})[r.sweep] = r.energy
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == grids(relaxation.relaxed(cells, palette).collect()) and cut.keys() == set(range(30))
    chosen = {(i, x, y): (set(c), p, o) for i, x, y, _, _, _, o, _, p, c in rows}
    for i, grid in cut.items():
        for (x, y), o in grid.items():
            allowed, held, before = chosen[i, x, y]
            assert o == before if held else o in allowed
    assert all(s[0] >= s[1] - 1e-9 >= s[2] - 2e-9 for s in steps.values())
    assert grids(relaxation.relaxed(cells, palette, coherence=0).collect()) == grids(cells.collect())


def plain_adaptation(cells, labs, most, coherence):
    """cells: {(x, y): (target, fixed or None, editable)}, labels from 0."""
    apart = color.e2000_matrix(labs, labs) / 45 + 0.35 * (1 - np.eye(len(labs)))
    now = {q: t if f is None else f for q, (t, f, _) in cells.items()}
    order = sorted(cells, key=lambda q: (q[1], q[0]))
    for _ in range(4):
        for q in order:
            target, fixed, editable = cells[q]
            if fixed is None and editable:
                own = apart[target].copy()
                for dx, dy in SIDES:
                    n = (q[0] + dx, q[1] + dy)
                    if n in now:
                        own += coherence
                        own[now[n]] -= coherence
                now[q] = int(own.argmin())
    changed = [q for q in order if cells[q][1] is None and now[q] != cells[q][0]]
    fixed = [q for q in order if cells[q][1] is not None]
    far = lambda q: min((abs(q[0] - x) + abs(q[1] - y) for x, y in fixed), default=0)
    kept = set(sorted(changed, key=lambda q: (far(q), q[1], q[0]))[: len(changed) if most is None else most])
    return {q: (now[q] if cells[q][1] is not None or q in kept else cells[q][0], q in kept) for q in cells}


@pytest.mark.parametrize("most", [None, 0, 4])
def test_adaptation_matches_a_plain_version(spark, most):
    rng = random.Random(7)
    palette = palette_of((0, 0), (5, 5), (40, -20), (-10, 40))
    images = {i: {(x, y): (rng.randrange(4), rng.randrange(4) if rng.random() < 0.1 and i else None, rng.random() < 0.8) for y in range(rng.randint(1, 8)) for x in range(6) if rng.random() < 0.9} for i in range(20)}
    rows = [(i, x, y, t + 1, None if f is None else f + 1, e) for i, cells in images.items() for (x, y), (t, f, e) in cells.items()]
    cells = spark.createDataFrame(rows, "image_id long, x int, y int, ord int, fixed int, editable boolean")
    got = {}
    for r in relaxation.adapted(cells, palette, most, coherence=0.2).collect():
        got.setdefault(r.image_id, {})[r.x, r.y] = (r.ord - 1, r.changed)
    labs = np.array([list(p["lab"].values()) for p in palette])
    for i, own in images.items():
        assert got.get(i, {}) == plain_adaptation(own, labs, most, 0.2)


def test_adaptation_refuses_wrong_options(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1)], "image_id long, x int, y int, ord int")
    for wrong in ({"coherence": -1.0}, {"coherence": float("nan")}, {"most_changes": -1}):
        with pytest.raises(ValueError):
            relaxation.adapted(cells, palette_of((0, 0)), **wrong)
    assert [tuple(r) for r in relaxation.adapted(cells, palette_of((0, 0))).collect()] == [(1, 0, 0, 1, 1, False)]


def test_logs_are_joined_in_order(spark):
    log = "image_id long, seq int, x int, y int, before int, after int, reason string"
    one, two = spark.createDataFrame([(1, 1, 0, 0, 1, 2, "a"), (1, 2, 1, 0, 1, 2, "b")], log), spark.createDataFrame([(1, 1, 5, 0, 1, 2, "c"), (2, 1, 5, 0, 1, 2, "d")], log)
    got = sorted((r.image_id, r.seq, r.reason) for r in relaxation.joined_logs(one, two).collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")]
