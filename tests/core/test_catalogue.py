"""Each registered query against its DuckDB SQL, and kernels against small known grids."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import color, scalars
from tessella.operators import editing, gate, generate, kernels, protocol, raster
from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def frame(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    return df[columns].sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_query_matches_sql(spark, duck, name):
    got, expected = frame(catalogue.QUERIES[name](spark, SF).toPandas()), frame(duck.sql(catalogue.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)


def test_known_color_difference(spark):
    lab = lambda *v: F.struct(*(F.lit(float(x)).alias(k) for k, x in zip("lab", v, strict=True)))
    row = spark.range(1).select(color.delta_e2000(lab(50, 2.6772, -79.7751), lab(50, 0, -82.7485)).alias("d"), color.delta_e2000(lab(50, 0, 0), lab(50, 0, 0)).alias("z")).first()
    assert abs(row.d - 2.0425) < 1e-4 and row.z == 0


def test_scalars(spark):
    row = spark.range(1).select(scalars.fnv1a(F.lit("a")).alias("h"), scalars.disk_cells(F.lit(1.0)).alias("d"), scalars.wilson(F.lit(0.0), F.lit(0.0)).alias("w"), scalars.bounded_message(F.lit("  a \n b ")).alias("m")).first()
    assert (row.h, row.d, row.w.lower, row.m) == (3826002220, 5, None, "a b")


def test_components_and_holes():
    ring = np.array([[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1]], bool)
    assert [int(p.sum()) for p in kernels.labelled(ring)] == [8, 1] and kernels.hole_count(ring) == 1
    assert kernels.hole_count(np.zeros((3, 3), bool)) == 0


def test_contours_close_around_components_and_holes():
    rng = np.random.default_rng(2)
    ring = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert sorted(kernels.signed_area(x) for x in kernels.contours(ring)) == [-1, 9]
    assert [kernels.signed_area(x) for x in kernels.contours(np.eye(2, dtype=bool))] == [1, 1]
    for _ in range(50):
        on = rng.random((6, 7)) < 0.5
        loops = kernels.contours(on)
        assert sum(map(kernels.signed_area, loops)) == on.sum()
        assert sum(kernels.signed_area(x) > 0 for x in loops) == len(kernels.labelled(on))
        assert sum(kernels.signed_area(x) < 0 for x in loops) == kernels.hole_count(on)


def test_squared_distance_is_exact():
    on = np.random.default_rng(1).random((7, 9)) < 0.2
    on[3, 3] = True
    y, x = np.nonzero(on)
    grid = np.array([[((y - r) ** 2 + (x - c) ** 2).min() for c in range(9)] for r in range(7)])
    assert (kernels.squared_distance(on) == grid).all()


def test_palette_is_bounded(spark):
    many = spark.range(200).select(F.col("id").cast("int").alias("ord"), *(F.lit(0).alias(c) for c in "rgb"))
    with pytest.raises(ValueError):
        raster.palette_rows(many)


def test_replay_of_a_hot_attempt_is_spread_over_ranges(spark):
    rng = np.random.default_rng(5)
    kinds = [*protocol.EVENTS, "jump", None]
    rows = [
        (int(u), i, kinds[k], None if i % 40 == 0 else float(i), [True, False, None][a], ["left", "no"][c], "E", "m", bool(a))
        for i, (u, k, a, c) in enumerate(zip(np.where(rng.random(6000) < 0.5, 0, rng.integers(0, 1500, 6000)), rng.integers(0, len(kinds), 6000), rng.integers(0, 3, 6000), rng.integers(0, 2, 6000), strict=True))
    ]
    rows += [(-1, n, k, 1.0, False, "tie", "E", "m", True) for n, k in enumerate(["rate-initial", "start-editing", "confirm-editing", "rate-corrected-mask", "rate-blind-pattern", "export"])]
    events = spark.createDataFrame(rows, "attempt_id long, ord long, type string, at double, acceptable boolean, choice string, code string, message string, has_snapshot boolean")
    state = {}
    for u, _, kind, at, ok, choice, _, _, snap in rows:  # by order of events
        stage, verdict, error = state.get(u, ("sample-loaded", None, None))
        if error:
            continue
        payload = {"rate-initial": ok is not None, "rate-corrected-mask": ok is not None, "rate-blind-pattern": choice == "left" or choice == "tie", "confirm-editing": snap}.get(kind, True)
        allowed = {"rate-initial": ["sample-loaded"], "accept-original": ["initial-rated"], "start-editing": ["initial-rated"], "confirm-editing": ["editing"], "cancel-editing": ["editing"], "record-error": ["initial-rated", "editing", "confirmed"],
                   "rate-corrected-mask": ["confirmed"], "rate-blind-pattern": ["corrected-mask-rated"], "export": ["accepted", "cancelled", "error", "blind-pattern-rated"]}
        after = {"accept-original": "accepted", "start-editing": "editing", "confirm-editing": "confirmed", "cancel-editing": "cancelled", "record-error": "error", "rate-corrected-mask": "corrected-mask-rated", "rate-blind-pattern": "blind-pattern-rated", "export": "exported", "rate-initial": "initial-rated"}
        error = "time" if at is None else "unknown-event" if kind not in allowed else "stage" if stage not in allowed[kind] else "rating" if kind == "accept-original" and not verdict or kind == "start-editing" and verdict else None if payload else "payload"
        if error is None:
            stage, verdict = after[kind], ok if kind == "rate-initial" else None
        state[u] = (stage, verdict, error)
    got = {r.attempt_id: (r.stage, r.rated, r.error) for r in protocol.replayed(events, ranges=16).collect()}
    assert got == state and got[-1] == ("exported", None, None)
    maps = protocol.stage_maps(events, ranges=16).collect()
    assert 4 < sum(r.attempt_id == 0 for r in maps) <= 16 and len(maps) <= len(state) + 16


def test_sessions_undo_redo_and_refuse(spark):
    log = ["append", "append", "undo", "append", "redo", "undo", "undo", "undo", "redo", "confirm", "append"]
    rows = [("a", n, op) for n, op in enumerate(log)] + [("b", n, "append") for n in range(5)] + [("b", 5, "confirm"), ("c", 0, "redo"), ("c", 1, "undo")]
    got = {r.session: r for r in editing.replayed_sessions(spark.createDataFrame(rows, "session string, ord int, op string"), most=4).collect()}
    assert (got["a"].strokes, got["a"].cursor, got["a"].active, got["a"].dirty, got["a"].refused) == ([0, 10], 2, [0, 10], True, 0)
    assert (got["b"].strokes, got["b"].dirty, got["b"].refused) == ([0, 1, 2, 3], False, 1)
    assert (got["c"].strokes, got["c"].cursor) == ([], 0)


def test_fingerprints(spark):
    import hashlib
    import struct

    rows = [(1, x, y, (x + 2 * y) / 7) for x in range(2) for y in range(3)]
    row = kernels.fingerprints(spark.createDataFrame(rows, "image_id long, x int, y int, v double")).first()
    values = [v for _, _, _, v in sorted(rows, key=lambda r: (r[2], r[1]))]
    assert row.digest == hashlib.sha256(struct.pack(">6d", *values)).hexdigest() and len(row.lanes) == 16
    assert kernels.paired_lanes(b"") == "811c9dc59e3779b9" and kernels.paired_lanes(b"a")[:8] == "e40c292c"


def test_strokes_of_a_long_session(spark):
    rng = np.random.default_rng(6)
    rows = [("s", int(o), ["add", "erase"][m], float(x), float(y), 0.3) for o, m, x, y in zip(rng.permutation(9000), rng.integers(0, 2, 9000), rng.random(9000), rng.random(9000), strict=True)]
    strokes = spark.createDataFrame(rows, "session string, ord long, mode string, px double, py double, radius double")
    cells = {}
    for _, _, mode, px, py, r in sorted(rows, key=lambda r: r[1]):
        for x in range(4):
            for y in range(4):
                square = (x - px * 3) * (x - px * 3) + (y - py * 3) * (y - py * 3)
                if square <= (r * 4) * (r * 4):
                    b, v = 1 - np.sqrt(square) / (r * 4), cells.get((x, y), 0.0)
                    cells[x, y] = max(v, b) if mode == "add" else min(v, 1 - b)
    assert {(r.x, r.y): r.v for r in editing.painted(strokes, 4).collect()} == cells
    for n in (0, 1, 4096, 5000, 9999):
        modes = [r[2] for r in sorted(rows, key=lambda r: r[1])[:n]]
        assert [tuple(r) for r in editing.prefix_counts(strokes, F.lit(n)).collect()] == [("s", modes.count("add"), modes.count("erase"), len(modes))]
    plan = editing.prefix_counts(strokes, F.lit(3))._jdf.queryExecution().toString() + editing.painted(strokes, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(struct(ord") == 0 and "turns" in plan  # no array of a whole session


def test_sample_order_numbers_rows_by_ranges(spark):
    import hashlib

    ids = [*range(3000), 7, 7]
    rows = gate.sample_order(spark.createDataFrame([(i,) for i in ids], "image_id long"), "x").collect()
    ordered = sorted(ids, key=lambda i: (hashlib.sha256(f"x:{i}".encode()).hexdigest(), i))
    assert [r.image_id for r in sorted(rows, key=lambda r: r.position)] == ordered and sorted(r.position for r in rows) == list(range(1, len(ids) + 1))
    plan = gate.sample_order(spark.range(9).withColumnRenamed("id", "image_id"), "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(range" in plan


def test_a_red_and_blue_image_keeps_its_halves(spark):
    frames = spark.createDataFrame([(7, 8, 8, 0.0, 0.0, 8.0, 8.0)], "image_id long, width int, height int, cx double, cy double, cw double, ch double")
    pixels = spark.createDataFrame([(7, x, y, *((255, 0, 0) if x < 4 else (0, 0, 255)), 255) for x in range(8) for y in range(8)], "image_id long, x int, y int, r int, g int, b int, a int")
    palette = spark.createDataFrame([(1, 0, 0, 255), (2, 255, 0, 0), (3, 0, 255, 0)], "ord int, r int, g int, b int")
    for baseline in ("a0", "a1", "mvp"):
        options = generate.Options(((4, 4),), ("faithful",), max_colors=2, baseline=baseline)
        cells, measures = generate.candidates(frames, pixels, palette, options)
        assert {(r.x, r.ord) for r in cells.collect()} == {(0, 2), (1, 2), (2, 1), (3, 1)}
        row = measures.first()
        assert (row.image_id, row.cells, row.colors, row.isolated, row.stripes) == (7, 16, 2, 0, 0) and row.plan < 1e-6
        assert [r.status for r in generate.ranked(measures, options).collect()] == ["success"]
