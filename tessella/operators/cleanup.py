"""Clean-up of grids that spares protected cells, with a log of every edit.

Three passes follow one another, each over the grid that its predecessor left: small regions, stripes, alias. A frame holds
one row a cell: the grid before (`ord`) and after each pass (`regions`, `stripes`, `alias`), so the final grid and the log are
projections of one plan. Rows are dealt once by image for components (a kernel) and once for all windows. Neighbours are range
frames over one order of an image's cells, so grids may have gaps (inactive cells) and one sort serves all frames.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import kernels

#: Rows of a grid are this far apart in the order of its cells; wider than any grid.
STRIDE = 1 << 20
SIDES = ((-1, 0), (1, 0), (0, -1), (0, 1))
AROUND = tuple((dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy)
PASSES = ("regions", "stripes", "alias")


@dataclass(frozen=True)
class Penalties:
    """Regions below `least_region` cells go if `isolated` times their support exceeds their size; a penalty of 0 leaves a pass out."""

    least_region: int = 2
    isolated: float = 1.0
    stripe: float = 1.0
    alias: float = 1.0


def component_ids(values: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """For each cell the smallest place (row by row) in its region of equal values, over sides or also corners; cells below 0 are outside, -1.

    values: one grid, or several of one size, (grids, height, width).
    """
    places = np.arange(values.size).reshape(values.shape)
    ends = [(np.s_[..., :, :-1], np.s_[..., :, 1:]), (np.s_[..., :-1, :], np.s_[..., 1:, :])]
    if diagonal:
        ends += [(np.s_[..., :-1, :-1], np.s_[..., 1:, 1:]), (np.s_[..., :-1, 1:], np.s_[..., 1:, :-1])]
    like = [values[a] == values[b] for a, b in ends]
    one, other = (np.concatenate([places[pair[k]][same] for pair, same in zip(ends, like, strict=True)]) for k in (0, 1))
    root = np.arange(values.size)
    while True:
        a, b = root[one], root[other]
        open_ = a != b
        if not open_.any():
            break
        one, other, a, b = one[open_], other[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return np.where(values >= 0, root.reshape(values.shape), -1)


def _components(table: pa.Table) -> pa.Table:
    grid = kernels._grid(table, "ord", -1).astype(np.int64)
    ids = component_ids(grid)[table.column("y").to_numpy(), table.column("x").to_numpy()]
    return table.append_column("component", pa.array(ids, pa.int64()))


def _cells() -> Column:
    return F.col("y") * STRIDE + F.col("x")


def beside(column: Column, dx: int, dy: int) -> Column:
    """The column's value (not text) in the cell at that offset, null if the grid doesn't have it."""
    step = dy * STRIDE + dx
    return F.max(column).over(Window.partitionBy("image_id").orderBy("place").rangeBetween(step, step))


def _small_regions(frame: DataFrame, penalties: Penalties) -> DataFrame:
    near = frame.select("*", *(beside(F.struct("component", "ord"), dx, dy).alias(f"n{k}") for k, (dx, dy) in enumerate(SIDES)))
    whole = Window.partitionBy("image_id", "component")
    sized = near.select("*", F.count("*").over(whole).cast("int").alias("size"), F.max("protected").over(whole).alias("spared"))
    # Only regions below the limit gather their neighbours: at most 4 for each of their cells.
    small = (F.col("size") < penalties.least_region) & ~F.col("spared")
    outside = F.transform(F.filter(F.array(*(F.col(f"n{k}") for k in range(4))), lambda n: n.isNotNull() & (n.component != F.col("component"))), lambda n: n.ord)
    votes = sized.select("*", F.flatten(F.collect_list(F.when(small, outside)).over(whole)).alias("votes"))
    support = lambda v: F.size(F.filter("votes", lambda o: o == v))
    top = F.array_max(F.transform(F.array_distinct("votes"), lambda v: F.struct(support(v).alias("n"), (-v).alias("less"))))
    best = votes.select("*", F.when(small & (F.size("votes") > 0), top).alias("top"))
    moves = penalties.isolated * F.col("top.n") > F.col("size")
    return best.select(*frame.columns, "size", F.when(moves, -F.col("top.less")).otherwise(F.col("ord")).cast("int").alias("regions"))


def _stripes(frame: DataFrame, penalty: float) -> DataFrame:
    near = frame.select("*", *(beside(F.col("regions"), dx, dy).alias(f"n{k}") for k, (dx, dy) in enumerate(SIDES)))
    inner = F.lit(penalty > 0) & ~F.col("protected")
    for k in range(4):
        inner = inner & F.col(f"n{k}").isNotNull()
    pair = lambda a, b: F.when(inner & (F.col(a) == F.col(b)) & (F.col(a) != F.col("regions")), F.col(a))
    both = near.select("*", pair("n0", "n1").alias("across"), pair("n2", "n3").alias("along"))
    one = F.coalesce("across", "along")
    agree = F.col("across").isNull() | F.col("along").isNull() | (F.col("across") == F.col("along"))
    weight = F.when(F.col("across") == F.col("along"), 2).otherwise(1)
    return both.select(*frame.columns, F.when(one.isNotNull() & agree & (penalty * weight > 0.5), one).otherwise(F.col("regions")).alias("stripes"))


def _alias(frame: DataFrame, penalty: float) -> DataFrame:
    near = frame.select("*", *(beside(F.col("stripes"), dx, dy).alias(f"n{k}") for k, (dx, dy) in enumerate(AROUND)))
    times = lambda v: sum((F.coalesce((F.col(f"n{k}") == v).cast("int"), F.lit(0)) for k in range(8)), F.lit(0))
    # What six of eight neighbours are, one of any three is.
    dominant = F.coalesce(*(F.when(times(F.col(f"n{k}")) >= 6, F.col(f"n{k}")) for k in range(3)))
    sides = sum((F.coalesce((F.col(f"n{k}") == F.col("stripes")).cast("int"), F.lit(0)) for k, (dx, dy) in enumerate(AROUND) if not dx or not dy), F.lit(0))
    told = near.select("*", dominant.alias("dominant"), sides.alias("sides"))
    inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("width") - 1) & (F.col("y") < F.col("height") - 1)
    gain = penalty * (times(F.col("dominant")) - times(F.col("stripes")))
    moves = F.lit(penalty > 0) & inner & ~F.col("protected") & F.col("dominant").isNotNull() & (F.col("dominant") != F.col("stripes")) & (F.col("sides") <= 1) & (gain > 1)
    return told.select(*frame.columns, F.when(moves, F.col("dominant")).otherwise(F.col("stripes")).alias("alias"))


def cleaned(cells: DataFrame, protected: DataFrame | None = None, penalties: Penalties | None = None) -> DataFrame:
    """image_id, x, y, ord, protected, component, size, regions, stripes, alias: the grid before and after each pass.

    cells: image_id, x, y and ord (from 0) of the active cells, and, if the canvas is larger than these, its width and height.
    protected: image_id, x and y of cells that no pass changes; a region that holds one stays whole, unless a later pass changes
    its other cells. Ties of support go to the smaller ord.
    """
    penalties = penalties or Penalties()
    sized = {"width", "height"} <= set(cells.columns)
    grid = cells.select("image_id", "x", "y", F.col("ord").cast("int").alias("ord"), *(F.col(c).cast("int").alias(c) for c in ("width", "height") if sized))
    if protected is None:
        held = grid.withColumn("protected", F.lit(False))
    else:
        marks = protected.select("image_id", "x", "y").distinct().withColumn("held", F.lit(True))
        held = grid.join(marks, ["image_id", "x", "y"], "left").withColumn("protected", F.coalesce("held", F.lit(False))).drop("held")
    schema = held.withColumn("component", F.lit(0).cast("long")).schema
    frame = held.groupBy("image_id").applyInArrow(_components, schema).repartition("image_id").withColumn("place", _cells())
    if not sized:
        image = Window.partitionBy("image_id")
        frame = frame.withColumns({"width": F.max("x").over(image) + 1, "height": F.max("y").over(image) + 1})
    out = _alias(_stripes(_small_regions(frame, penalties), penalties.stripe), penalties.alias)
    return out.select("image_id", "x", "y", "ord", "protected", "component", "size", *PASSES)


def cleaned_grids(labels: np.ndarray, protected: np.ndarray, penalties: Penalties) -> np.ndarray:
    """Labels after the three passes, as `cleaned` gives them, of grids of one size in memory: (grids, height, width), -1 outside."""
    count, height, width = labels.shape

    def around(grid: np.ndarray, dx: int, dy: int, outside: int = -1) -> np.ndarray:
        wide = np.full((count, height + 2, width + 2), outside, grid.dtype)
        wide[:, 1:-1, 1:-1] = grid
        return wide[:, 1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width]

    inside, ids = labels >= 0, component_ids(labels)
    size = np.bincount(ids[inside], minlength=labels.size)
    spared = np.zeros(labels.size, bool)
    spared[ids[inside & protected]] = True
    small = inside & (size[ids] < penalties.least_region) & ~spared[ids]
    regions = labels
    if small.any():
        names, number = np.unique(ids[small], return_inverse=True)
        votes = np.zeros((len(names), int(labels.max()) + 1), np.int64)
        for dx, dy in SIDES:
            other = around(labels, dx, dy)[small]
            counts = (other >= 0) & (around(ids, dx, dy)[small] != names[number])
            np.add.at(votes, (number[counts], other[counts]), 1)
        top = votes.argmax(axis=1)  # ties to the smaller label
        moves = penalties.isolated * votes.max(axis=1) > size[names]
        regions = labels.copy()
        regions[small] = np.where(moves[number], top[number], labels[small])
    left, right, above, below = (around(regions, dx, dy) for dx, dy in SIDES)
    inner = inside & ~protected & (left >= 0) & (right >= 0) & (above >= 0) & (below >= 0)
    across, along = (inner & (a == b) & (a != regions) for a, b in ((left, right), (above, below)))
    same = left == above
    takes = (across | along) & (~across | ~along | same) & (penalties.stripe * np.where(across & along & same, 2, 1) > 0.5)
    stripes = np.where(takes & (penalties.stripe > 0), np.where(across, left, above), regions)
    near = np.stack([around(stripes, dx, dy) for dx, dy in AROUND])
    times = lambda v: (near == v).sum(axis=0)
    dominant = np.full(labels.shape, -1)
    for k in (2, 1, 0):
        dominant = np.where((near[k] >= 0) & (times(near[k]) >= 6), near[k], dominant)
    like = near == stripes
    sides = sum(like[k].astype(np.int64) for k, (dx, dy) in enumerate(AROUND) if not dx or not dy)
    core = np.zeros(labels.shape, bool)
    core[:, 1:-1, 1:-1] = True
    moves = core & inside & ~protected & (dominant >= 0) & (dominant != stripes) & (sides <= 1) & (penalties.alias * (times(dominant) - like.sum(axis=0)) > 1)
    return np.where(moves & (penalties.alias > 0), dominant, stripes)


def final_grid(frame: DataFrame) -> DataFrame:
    """image_id, x, y and ord after the last pass."""
    return frame.select("image_id", "x", "y", F.col(PASSES[-1]).alias("ord"))


def edit_log(frame: DataFrame) -> DataFrame:
    """image_id, seq (from 1), x, y, before, after, reason: edits in the order of the passes; region by region, then row by row."""
    region = F.when(F.col("size") == 1, "isolated-cell").otherwise("small-region")
    steps = zip(PASSES, ("ord", *PASSES), (region, F.lit("stripe"), F.lit("topology")), strict=False)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("pass"), F.col(b).alias("before"), F.col(a).alias("after"), why.alias("reason")) for k, (a, b, why) in enumerate(steps))))
    edits = frame.select("image_id", "x", "y", "component", each.alias("e")).where("e.before <> e.after")
    order = Window.partitionBy("image_id").orderBy("e.pass", F.when(F.col("e.pass") == 0, F.col("component")).otherwise(0), "y", "x")
    return edits.select("image_id", F.row_number().over(order).alias("seq"), "x", "y", "e.before", "e.after", "e.reason")


def edit_counts(log: DataFrame) -> DataFrame:
    """image_id and the number of edits of each reason."""
    return log.groupBy("image_id").agg(*(F.count(F.when(F.col("reason") == r, 1)).alias(r.replace("-", "_")) for r in ("isolated-cell", "small-region", "stripe", "topology")))
