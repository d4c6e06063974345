"""Labels of grids that settle cell by cell: edge-aware smoothing of colours, and adaptation to fixed cells.

Each cell takes the label of the least energy: its own cost of the label plus a weight for every side neighbour of another label.
Cells change in raster order, each seeing its predecessors' new labels. Those of one anti-diagonal don't touch, so they
change together with the same result; images of one size go through their diagonals side by side. No energy ever rises.

Rows are dealt and sorted by image once, and stream through tasks: a task holds one batch and one image, of at most `kernels.MOST_CELLS` cells.
Rows with a null image id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.operators import kernels, raster

SIDES = ((0, -1), (0, 1), (-1, 0), (1, 0))
#: How importance lifts a cell's own cost, the weight of one unit of coherence, and the difference that counts as a whole edge.
OWN, LIFT, UNIT, EDGE = 0.75, 0.55, 16.0, 60.0
#: The difference that counts as 1 in adaptation, and the cost of leaving the target.
ADAPT_SCALE, LEAVING, ADAPT_SWEEPS = 45.0, 0.35, 4


def whole_images(batches: Iterator[pa.RecordBatch], least: int = 0, most: int = kernels.MOST_CELLS) -> Iterator[pa.Table]:
    """Rows sorted by image, in tables of whole images and at least so many rows (but the last); the image that a batch ends in goes to the next table."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("image_id").to_numpy()
        turns = np.flatnonzero(np.diff(ids)) + 1
        if rest and rest[-1].column("image_id")[-1].as_py() != ids[0]:
            turns = np.concatenate([[0], turns])
        if len(turns) and sum(b.num_rows for b in rest) + (cut := int(turns[-1])) >= least:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
            rest = []
            batch = batch.slice(cut)
        rest.append(batch)
        if sum(b.num_rows for b in rest) > most and rest[0].column("image_id")[0] == rest[-1].column("image_id")[-1]:
            raise ValueError(f"a grid has at most {most} cells")
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def settled(labels: np.ndarray, cost: np.ndarray, right: np.ndarray, down: np.ndarray, free: np.ndarray, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, energies before and after each sweep) of images of one size.

    labels: (images, height, width), -1 outside; cost: (images, height, width, labels), infinite where a label isn't allowed; right and
    down: weights of the sides between a cell and the next; free: cells that may change. An image that a sweep leaves as it is has settled.
    """
    labels = labels.copy()
    _, height, width = labels.shape
    wide = np.full((len(labels), height + 2, width + 2), -1)
    wide[:, 1:-1, 1:-1] = labels
    weights = np.zeros((4, *labels.shape))  # towards left, right, top, bottom
    weights[0, :, :, 1:], weights[1, :, :, :-1] = right, right
    weights[2, :, 1:], weights[3, :, :-1] = down, down
    image, row, column = np.nonzero(free)
    diagonal = row + column
    order = np.argsort(diagonal, kind="stable")
    image, row, column = image[order], row[order], column[order]
    cuts = np.searchsorted(diagonal[order], np.arange(height + width))
    levels = [energy(wide[:, 1:-1, 1:-1], cost, right, down)]
    for _ in range(sweeps):
        before = wide.copy()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            i, y, x = image[a:b], row[a:b], column[a:b]
            own, cells = cost[i, y, x].copy(), np.arange(b - a)
            for k, (dy, dx) in enumerate(SIDES):
                other, weight = wide[i, y + 1 + dy, x + 1 + dx], weights[k, i, y, x]
                beside = other >= 0
                own += np.where(beside, weight, 0)[:, None]
                own[cells[beside], other[beside]] -= weight[beside]
            wide[i, y + 1, x + 1] = own.argmin(axis=1)
        levels.append(energy(wide[:, 1:-1, 1:-1], cost, right, down))
        if (before == wide).all():
            break
    levels += levels[-1:] * (sweeps + 1 - len(levels))
    return wide[:, 1:-1, 1:-1], np.stack(levels, axis=1)


def smoothed(own: np.ndarray, labels: np.ndarray, cost: np.ndarray, free: np.ndarray, coherence: float = 1.15, edge: float = 0.8, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """`settled`, where a side weighs less the more the two cells' own colours (images, height, width, Lab) differ."""
    far = lambda a, b: coherence * UNIT * (1 - edge * np.clip(np.sqrt(((a - b) ** 2).sum(axis=-1)) / EDGE, 0, 1))
    return settled(labels, cost, far(own[:, :, :-1], own[:, :, 1:]), far(own[:, :-1], own[:, 1:]), free, sweeps)


def energy(labels: np.ndarray, cost: np.ndarray, right: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Of each image: the costs of its labels and the weights of sides between unlike ones."""
    inside = labels >= 0
    own = np.where(inside, np.take_along_axis(cost, np.maximum(labels, 0)[..., None], axis=3)[..., 0], 0).sum(axis=(1, 2))
    unlike = lambda a, b: (a != b) & (a >= 0) & (b >= 0)
    return own + (unlike(labels[:, :, :-1], labels[:, :, 1:]) * right).sum(axis=(1, 2)) + (unlike(labels[:, :-1], labels[:, 1:]) * down).sum(axis=(1, 2))


def _stacks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int]]]:
    """(rows of the table, image in the stack, y, x, shape) of the images of each size."""
    ids, x, y = (table.column(c).to_numpy() for c in ("image_id", "x", "y"))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
    heights, widths = np.maximum.reduceat(y, starts) + 1, np.maximum.reduceat(x, starts) + 1
    number = np.repeat(np.arange(len(starts)), np.diff([*starts, len(ids)]))
    for height, width in sorted({*zip(heights.tolist(), widths.tolist(), strict=True)}):
        own = (heights == height) & (widths == width)
        rows = np.flatnonzero(own[number])
        yield rows, (np.cumsum(own) - 1)[number[rows]], y[rows], x[rows], (int(own.sum()), height, width)


def _grid(rows: np.ndarray, at: tuple, shape: tuple, values: np.ndarray, outside) -> np.ndarray:
    out = np.full((*shape, *values.shape[1:]), outside, values.dtype)
    out[at] = values[rows]
    return out


def _numbers(table: pa.Table, column: str, missing) -> np.ndarray:
    return table.column(column).fill_null(missing).to_numpy() if column in table.column_names else np.full(table.num_rows, missing)


def _sorted(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("image_id").isNotNull()).repartition("image_id").sortWithinPartitions("image_id", "y", "x")


def _allowed(table: pa.Table, ords: np.ndarray) -> np.ndarray:
    """Whether each row allows each label: those in its list `chosen`, or all without one."""
    if "chosen" not in table.column_names:
        return np.ones((table.num_rows, len(ords)), bool)
    lists = table.column("chosen").combine_chunks()
    out = np.zeros((table.num_rows, len(ords)), bool)
    out[np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy()), np.searchsorted(ords, lists.flatten().to_numpy())] = True
    return out


def relaxed(cells: DataFrame, palette: list[dict], coherence: float = 1.15, edge: float = 0.8, sweeps: int = 2, metric: str = "delta-e-2000", energies: bool = False) -> DataFrame:
    """image_id, x, y, ord of smoothed labels; or, with energies, image_id, sweep (0: before) and energy.

    cells: image_id, x, y, r, g, b and ord of active cells; optional are importance (1 where it lacks), protected (cells that keep
    their label) and chosen (the ords that an image may use). A neighbour of another colour costs less the more the two cells' own colours differ.
    """
    palette = sorted(palette, key=lambda p: p["ord"])
    ords, labs, distances = np.array([p["ord"] for p in palette], np.int64), raster.palette_labs(palette), color.MATRICES[metric]
    sweeps = sweeps if coherence > 0 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_images(batches):
            own = np.stack([table.column(c).to_numpy() for c in ("l", "a", "b")], axis=1)
            cost = distances(own, labs) * (OWN + LIFT * _numbers(table, "importance", 1.0))[:, None]
            cost[~_allowed(table, ords)] = np.inf
            labels, free = np.searchsorted(ords, table.column("ord").to_numpy()), ~_numbers(table, "protected", False).astype(bool)
            after, levels, named = np.zeros(len(labels), np.int64), [], []
            for rows, image, y, x, shape in _stacks(table):
                at = (image, y, x)
                of = lambda values, outside: _grid(rows, at, shape, values, outside)
                out, steps = smoothed(of(own, 0.0), of(labels, -1), of(cost, 0.0), of(free, False), coherence, edge, sweeps)
                after[rows] = out[at]
                levels.append(steps)
                named.append(table.column("image_id").to_numpy()[rows[np.searchsorted(image, np.arange(shape[0]))]])
            if energies:
                ids, values = np.concatenate(named), np.concatenate(levels)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sweeps + 1), pa.int64()), pa.array(np.tile(np.arange(sweeps + 1), len(ids)), pa.int32()), pa.array(values.ravel(), pa.float64())], names=["image_id", "sweep", "energy"])
            else:
                plain = [table.column(c).combine_chunks() for c in ("image_id", "x", "y")]
                yield from pa.table([*plain, pa.array(ords[after], pa.int32())], names=["image_id", "x", "y", "ord"]).to_batches()

    own = cells.withColumn("lab", color.lab(*map(F.col, "rgb")))
    more = [c for c in ("importance", "protected", "chosen") if c in cells.columns]
    image = F.col("image_id").cast("long").alias("image_id")
    flat = _sorted(own.select(image, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("ord").cast("int").alias("ord"), "lab.l", "lab.a", "lab.b", *more))
    return flat.mapInArrow(run, "image_id long, sweep int, energy double" if energies else "image_id long, x int, y int, ord int")


def changed_labels(before: DataFrame, after: DataFrame) -> DataFrame:
    """image_id, seq (from 1), x, y, before, after, reason of the cells whose label smoothing changed, row by row."""
    both = before.select("image_id", "x", "y", F.col("ord").alias("before")).join(after.select("image_id", "x", "y", F.col("ord").alias("after")), ["image_id", "x", "y"]).where("before <> after")
    return both.select("image_id", F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x")).alias("seq"), "x", "y", "before", "after", F.lit("palette-coherence").alias("reason"))


def joined_logs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two logs of edits as one: the second's follow the first's of the same image."""
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("image_id").orderBy("part", "seq"))).drop("part")


def nearest_fixed(fixed: np.ndarray) -> np.ndarray:
    """Steps (over sides) from each cell to the nearest fixed one of its image; 0 if there is none."""
    far = np.where(fixed, 0.0, np.inf)
    for axis in (1, 2):
        place = np.arange(far.shape[axis]).reshape([-1 if a == axis else 1 for a in range(3)])
        ahead = np.minimum.accumulate(far - place, axis=axis) + place
        back = np.flip(np.minimum.accumulate(np.flip(far + place, axis), axis=axis), axis) - place
        far = np.minimum(ahead, back)
    return np.where(np.isinf(far), 0, far)


def adapted(cells: DataFrame, palette: list[dict], most_changes: int | None = None, coherence: float = 1.4, sweeps: int = ADAPT_SWEEPS) -> DataFrame:
    """image_id, x, y, target, ord, changed: labels after adaptation to fixed cells.

    cells: image_id, x, y, ord (the target), and, if there, fixed (an ord that the cell takes and keeps, or null) and editable.
    Beyond most_changes, the changes nearest to a fixed cell stay (ties row by row) and all others go back to their target.
    """
    if not 0 <= coherence < float("inf") or (most_changes is not None and most_changes < 0):
        raise ValueError("coherence is a finite number of at least 0, and most_changes at least 0")
    palette = sorted(palette, key=lambda p: p["ord"])
    ords, labs = np.array([p["ord"] for p in palette], np.int64), raster.palette_labs(palette)
    apart = color.e2000_matrix(labs, labs) / ADAPT_SCALE + LEAVING * (1 - np.eye(len(labs)))  # of each target's each label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_images(batches):
            target, fixed = np.searchsorted(ords, table.column("ord").to_numpy()), _numbers(table, "fixed", -1)
            held = fixed >= 0
            free = ~held & _numbers(table, "editable", True).astype(bool)
            labels = np.where(held, np.searchsorted(ords, fixed), target)
            after, steps = np.zeros(len(labels), np.int64), np.zeros(len(labels))
            for rows, image, y, x, shape in _stacks(table):
                at = (image, y, x)
                sides = np.full((shape[0], shape[1], shape[2] - 1), coherence), np.full((shape[0], shape[1] - 1, shape[2]), coherence)
                out, _ = settled(_grid(rows, at, shape, labels, -1), apart[_grid(rows, at, shape, target, 0)], *sides, _grid(rows, at, shape, free, False), sweeps)
                after[rows] = out[at]
                steps[rows] = nearest_fixed(_grid(rows, at, shape, held, False))[at]
            plain = [table.column(c).combine_chunks() for c in ("image_id", "x", "y", "ord")]
            values = [pa.array(ords[after], pa.int32()), pa.array(held), pa.array(steps.astype(np.int64), pa.int64())]
            yield from pa.table([*plain, *values], names=["image_id", "x", "y", "target", "ord", "held", "steps"]).to_batches()

    more = [F.col(c).cast(t).alias(c) for c, t in (("fixed", "int"), ("editable", "boolean")) if c in cells.columns]
    image = F.col("image_id").cast("long").alias("image_id")
    flat = _sorted(cells.select(image, *(F.col(c).cast("int").alias(c) for c in ("x", "y", "ord")), *more))
    out = flat.mapInArrow(run, "image_id long, x int, y int, target int, ord int, held boolean, steps long")
    moved = ~F.col("held") & (F.col("ord") != F.col("target"))
    nth = F.row_number().over(Window.partitionBy("image_id").orderBy((~moved).cast("int"), "steps", "y", "x"))
    kept = moved if most_changes is None else moved & (nth <= most_changes)
    told = out.withColumn("changed", kept)
    return told.select("image_id", "x", "y", "target", F.when(F.col("held") | F.col("changed"), F.col("ord")).otherwise(F.col("target")).alias("ord"), "changed")


def adaptation_report(cells: DataFrame) -> DataFrame:
    """image_id, changes, preserved (fixed cells of the pattern) and deviation: the share of cells without a fixed colour that changed.

    cells: what `adapted` gives, with the column fixed of its input.
    """
    sums = cells.groupBy("image_id").agg(F.count(F.when(F.col("changed"), 1)).alias("changes"), F.count("fixed").alias("preserved"), F.count("*").alias("n"))
    return sums.select("image_id", "changes", "preserved", (F.col("changes") / F.greatest(F.lit(1), F.col("n") - F.col("preserved"))).alias("deviation"))
