"""Raster operators over rows (image_id, x, y, ...): resampling, neighbourhoods, colour assignment, clean-up, masks.

Every operator is a narrow expression, a window over one image's rows, or an equi-join on (image_id, x, y);
images are independent, so all shuffles are by image.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.functions.color import clamped, rounded

#: A palette has at most this many colours; it is read to the driver and becomes literals of the plan.
MOST_COLORS = 128
CELL = ["image_id", "x", "y"]


def bounds(grid: DataFrame) -> DataFrame:
    return grid.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _row(column: str, step: int) -> Column:
    return F.lead(column, step).over(Window.partitionBy("image_id", "y").orderBy("x")) if step > 0 else F.lag(column, -step).over(Window.partitionBy("image_id", "y").orderBy("x"))


def _column(column: str, step: int) -> Column:
    return F.lead(column, step).over(Window.partitionBy("image_id", "x").orderBy("y")) if step > 0 else F.lag(column, -step).over(Window.partitionBy("image_id", "x").orderBy("y"))


def with_neighbours(grid: DataFrame, column: str) -> DataFrame:
    """left, right, top and bottom values (null outside) of a dense grid."""
    return grid.repartition("image_id").select("*", _row(column, -1).alias("left"), _row(column, 1).alias("right"), _column(column, -1).alias("top"), _column(column, 1).alias("bottom"))


# Resampling


def resize_nearest(pixels: DataFrame, source: int, target: int, values: list[str]) -> DataFrame:
    """Square images of side `source` to `target`: the pixel at each cell's rounded centre."""
    place = lambda c: F.greatest(F.lit(0), F.least(F.lit(source - 1), rounded((F.col(c) + 0.5) * source / target - 0.5))).cast("int")
    axis = F.explode(F.sequence(F.lit(0), F.lit(target - 1)))
    cells = pixels.select("image_id").distinct().select("image_id", axis.alias("gx")).select("*", axis.alias("gy"))
    wanted = cells.select("image_id", "gx", "gy", place("gx").alias("x"), place("gy").alias("y"))
    return wanted.join(pixels, CELL).select("image_id", F.col("gx").alias("x"), F.col("gy").alias("y"), *values)


def resize_bilinear(pixels: DataFrame, source: int, target: int, values: list[str]) -> DataFrame:
    """The four pixels around each cell's centre, weighted by nearness; edges are repeated. Each pixel is sent to the cells that it touches."""
    touched: list[list[Column]] = [[] for _ in range(source)]
    for g in range(target):
        at = (g + 0.5) * source / target - 0.5
        low = math.floor(at)
        for p, f in ((low, 1 - (at - low)), (low + 1, at - low)):
            touched[max(0, min(source - 1, p))].append(F.struct(F.lit(g).alias("c"), F.lit(float(f)).alias("f")))
    none = F.array().cast("array<struct<c: int, f: double>>")
    taps = F.array(*(F.array(*cells) if cells else none for cells in touched))  # one literal of at most 2 x target structs
    sent = pixels.select("image_id", *values, F.explode(F.get(taps, F.col("x"))).alias("cx"), "y").select("*", F.explode(F.get(taps, F.col("y"))).alias("cy"))
    weight = F.col("cx.f") * F.col("cy.f")
    return sent.groupBy("image_id", F.col("cx.c").alias("x"), F.col("cy.c").alias("y")).agg(*(F.sum(weight * F.col(v)).alias(v) for v in values))


def resize_area(pixels: DataFrame, source: int, target: int, values: list[str]) -> DataFrame:
    """Mean of the covered pixels, weighted by overlap: each pixel is sent to the few cells that it meets."""

    def cells(p: str) -> Column:
        first, last = F.floor(F.col(p) * target / source), F.ceil((F.col(p) + 1) * target / source) - 1
        overlap = lambda c: F.least((c + 1) * source / target, F.col(p) + 1) - F.greatest(c * source / target, F.col(p))
        return F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda c: F.struct(c.alias("c"), overlap(c).alias("f")))

    sent = pixels.select("image_id", *values, F.explode(cells("x")).alias("cx"), "y").select("*", F.explode(cells("y")).alias("cy"))
    weight = F.col("cx.f") * F.col("cy.f")
    sums = sent.groupBy("image_id", F.col("cx.c").alias("x"), F.col("cy.c").alias("y")).agg(F.sum(weight).alias("w"), *(F.sum(weight * F.col(v)).alias(v) for v in values))
    return sums.select("image_id", "x", "y", *((F.col(v) / F.col("w")).alias(v) for v in values))


def resize_guided(pixels: DataFrame, source: int, target: int, importance_strength: float = 4.0, edge_strength: float = 1.25) -> DataFrame:
    """Area means that lean to important and sharp pixels (columns importance and edge); a cell whose strongest
    pixel is important and stands out takes that pixel as it is."""

    def cells(p: str) -> Column:
        first, last = F.floor(F.col(p) * target / source), F.ceil((F.col(p) + 1) * target / source) - 1
        overlap = lambda c: F.least((c + 1) * source / target, F.col(p) + 1) - F.greatest(c * source / target, F.col(p))
        return F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda c: F.struct(c.alias("c"), overlap(c).alias("f")))

    strength = F.col("importance") * importance_strength + F.col("edge") * edge_strength
    sent = pixels.select("*", strength.alias("s"), F.explode(cells("x")).alias("cx")).select("*", F.explode(cells("y")).alias("cy"))
    weight = F.col("cx.f") * F.col("cy.f") * (1 + F.col("s"))
    peak = F.max(F.struct("s", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"), "importance", "r", "g", "b"))  # ties to the first in raster order
    sums = sent.groupBy("image_id", F.col("cx.c").alias("gx"), F.col("cy.c").alias("gy")).agg(F.sum(weight).alias("w"), F.avg("importance").alias("mean"), peak.alias("peak"), *(F.sum(weight * F.col(c)).alias(c) for c in "rgb"))
    stands_out = (F.col("peak.importance") >= 0.85) & (F.col("peak.importance") - F.col("mean") >= 0.25)
    return sums.select("image_id", F.col("gx").alias("x"), F.col("gy").alias("y"), *(F.when(stands_out, F.col(f"peak.{c}")).otherwise(rounded(F.col(c) / F.col("w"))).cast("int").alias(c) for c in "rgb"))


def reference_distance(pixels: DataFrame, assigned: DataFrame, palette: DataFrame, source: int, target: int, side: int = 96) -> DataFrame:
    """image_id, distance: mean CIEDE2000 between a reference raster of the source and the pattern's cells under it.

    The raster repeats few pairs of a pixel and a cell, so each pair is compared once and weighs as often as it is seen.
    """
    held = lambda v, n: max(0, min(n - 1, math.floor(v)))
    seen = Counter((held((i + 0.5) * source / side - 0.5 + 0.5, source), held((i + 0.5) / side * target, target)) for i in range(side))
    none = F.array().cast("array<struct<c: int, n: int>>")
    under = [[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for (q, c), n in sorted(seen.items()) if q == p] for p in range(source)]
    cells = F.array(*(F.array(*c) if c else none for c in under))
    sent = pixels.select("image_id", *"rgb", F.explode(F.get(cells, F.col("x"))).alias("cx"), "y").select("*", F.explode(F.get(cells, F.col("y"))).alias("cy"))
    return mean_color_distance(sent.select("image_id", F.col("cx.c").alias("x"), F.col("cy.c").alias("y"), *"rgb", (F.col("cx.n") * F.col("cy.n")).alias("times")), assigned, palette)


def edge_map(pixels: DataFrame) -> DataFrame:
    """image_id, x, y, edge: central difference of luminance, edges repeated."""
    lit = pixels.select(*CELL, color.luminance(*map(F.col, "rgb")).alias("l"))
    near = with_neighbours(lit, "l")
    own = lambda c: F.coalesce(c, "l")
    dx, dy = own("right") - own("left"), own("bottom") - own("top")
    return near.select(*CELL, clamped(F.sqrt(dx * dx + dy * dy) / 255, 0.0, 1.0).alias("edge"))


# Colours


def palette_rows(palette: DataFrame) -> list[dict]:
    """The palette with its Lab colours, in order; raises beyond MOST_COLORS."""
    rows = palette.withColumn("lab", color.lab(*map(F.col, "rgb"))).orderBy("ord").limit(MOST_COLORS + 1).collect()
    if len(rows) > MOST_COLORS:
        raise ValueError(f"a palette has at most {MOST_COLORS} colours")
    return [r.asDict(recursive=True) for r in rows]


def assign_nearest(pixels: DataFrame, palette: list[dict], metric: str = "rgb") -> DataFrame:
    """image_id, x, y, ord: the nearest colour, ties to the smaller ord. metric: rgb, delta-e-76 or delta-e-2000."""
    if metric == "rgb":
        square = lambda c, p: (F.col(c) - p[c]) * (F.col(c) - p[c])
        best = F.least(*(F.struct((square("r", p) + square("g", p) + square("b", p)).cast("double").alias("d"), F.lit(p["ord"]).alias("ord")) for p in palette))
        return pixels.select(*CELL, best["ord"].alias("ord"))
    return nearest(pixels.select(*CELL, color.lab(*map(F.col, "rgb")).alias("lab")), palette, metric)


def palette_labs(palette: list[dict]) -> np.ndarray:
    return np.array([[p["lab"][k] for k in ("l", "a", "b")] for p in palette], np.float64).reshape(-1, 3)


def nearest(cells: DataFrame, palette: list[dict], metric: str) -> DataFrame:
    """image_id, x, y, ord: the nearest colour to each cell's lab, ties to the smaller ord; among its ords in chosen, if there.

    A batch's distances to the whole palette are one matrix (at most MOST_COLORS wide), without a shuffle.
    """
    palette = sorted(palette, key=lambda p: p["ord"])
    ords, labs, distances = np.array([p["ord"] for p in palette], np.int64), palette_labs(palette), color.MATRICES[metric]
    limited = "chosen" in cells.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("l", "a", "b")], axis=1)
            far = distances(own, labs)
            if limited:
                lists = batch.column("chosen")
                allowed = np.zeros(far.shape, bool)
                rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                allowed[rows, np.searchsorted(ords, lists.flatten().to_numpy())] = True
                far[~allowed] = np.inf
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CELL), pa.array(ords[far.argmin(axis=1)], pa.int32())], names=[*CELL, "ord"])

    flat = cells.select(*CELL, "lab.l", "lab.a", "lab.b", *(["chosen"] if limited else []))
    schema = cells.select(*CELL).withColumn("ord", F.lit(0)).schema
    return flat.mapInArrow(run, schema)


def material_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("image_id", "ord").agg(F.count("*").alias("n"))


def mean_color_distance(pixels: DataFrame, assigned: DataFrame, palette: DataFrame) -> DataFrame:
    """image_id, distance: mean CIEDE2000 between pixels and their colours; a pixel counts as often as its column times says, if there."""
    colors = palette_rows(palette)
    ords, labs = np.array([p["ord"] for p in colors], np.int64), palette_labs(colors)
    times = F.col("times") if "times" in pixels.columns else F.lit(1)
    own = pixels.select(*CELL, color.lab(*map(F.col, "rgb")).alias("lab"), times.cast("long").alias("times"))
    flat = own.join(assigned.where(F.col("ord").isin(ords.tolist())), CELL).select(F.col("image_id").cast("long").alias("image_id"), F.col("ord").cast("long").alias("ord"), "lab.*", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lab = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("l", "a", "b")], axis=1)
            far = color.e2000_rows(lab, labs[np.searchsorted(ords, batch.column("ord").to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("times"), pa.array(far, pa.float64(), from_pandas=True)], names=["image_id", "times", "far"])

    told = flat.mapInArrow(run, "image_id long, times long, far double").groupBy("image_id")
    known = F.sum(F.when(F.col("far").isNotNull(), F.col("times")))
    return told.agg(F.coalesce(F.sum(F.col("far") * F.col("times")) / known, F.lit(0.0)).alias("distance"))


def boundary_agreement(pixels: DataFrame, assigned: DataFrame) -> DataFrame:
    """image_id, agreement: share of neighbour pairs whose colours differ by 12 or more exactly where labels differ."""
    both = pixels.join(assigned, CELL).select(*CELL, "ord", color.lab(*map(F.col, "rgb")).alias("lab"))
    near = both.select("image_id", "ord", "lab", _row("ord", 1).alias("o1"), _row("lab", 1).alias("l1"), _column("ord", 1).alias("o2"), _column("lab", 1).alias("l2"))
    pairs = near.select("image_id", "ord", "lab", F.explode(F.array(*(F.struct(F.col(f"o{k}").alias("o"), F.col(f"l{k}").alias("l")) for k in (1, 2)))).alias("n"))
    agrees = (color.delta_e76(F.col("lab"), F.col("n.l")) >= 12) == (F.col("ord") != F.col("n.o"))
    return pairs.where("n.o is not null").groupBy("image_id").agg(F.avg(agrees.cast("double")).alias("agreement"))


def greedy_palette(pixels: DataFrame, palette: list[dict], k: int, metric: str = "delta-e-76") -> DataFrame:
    """image_id, ords (sorted): the k colours that `greedy_order` adds first."""
    return greedy_order(pixels, palette, k, metric).select("image_id", F.array_sort("ords").alias("ords"))


def greedy_order(pixels: DataFrame, palette: list[dict], k: int, metric: str = "delta-e-76") -> DataFrame:
    """image_id, ords: k colours added one by one, each the one that lowers the summed distance most.

    Distances weigh by the column weight, if there; ties go to the smaller ord. An image's distances are one matrix in its
    group (at most 9,216 cells by MOST_COLORS), so that the plan doesn't grow with k.
    """
    weight = F.col("weight") if "weight" in pixels.columns else F.lit(1.0)
    rows = pixels.select(*CELL, color.lab(*map(F.col, "rgb")).alias("lab"), weight.cast("double").alias("weight")).select(*CELL, "lab.*", "weight")
    palette = sorted(palette, key=lambda p: p["ord"])
    ords, labs, distances = np.array([p["ord"] for p in palette]), palette_labs(palette), color.MATRICES[metric]

    def chosen(key: tuple, group: pa.Table) -> pa.Table:
        x, y, w, *lab = (group.column(c).to_numpy() for c in ("x", "y", "weight", "l", "a", "b"))
        order = np.lexsort((x, y))
        picked = greedy_picks(distances(np.stack(lab, axis=1)[order], labs), w[order], np.array([0]), k)[0]
        return pa.table({"image_id": pa.array([key[0].as_py()], pa.int64()), "ords": pa.array([ords[picked].tolist()], pa.list_(pa.int32()))})

    return rows.groupBy("image_id").applyInArrow(chosen, "image_id long, ords array<int>")


def greedy_picks(far: np.ndarray, weight: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """(images, k): of each image (the rows from each start on) the columns that are added one by one. far: of each row to each colour; weights aren't negative."""
    image = np.repeat(np.arange(len(starts)), np.diff([*starts, len(far)]))
    best, taken, picks = np.full(len(far), np.inf), np.zeros((len(starts), far.shape[1]), bool), []
    weighed, least = far * weight[:, None], np.empty(far.shape)
    for _ in range(min(k, far.shape[1])):
        cost = np.round(np.add.reduceat(np.minimum(best[:, None], weighed, out=least), starts, axis=0), 6)
        cost[taken] = np.inf
        picks.append(cost.argmin(axis=1))  # the first of equal ones, by ord
        taken[np.arange(len(starts)), picks[-1]] = True
        best = np.minimum(best, weighed[np.arange(len(far)), picks[-1][image]])
    return np.stack(picks, axis=1)


# Grid quality and clean-up


def isolated_cells(assigned: DataFrame) -> DataFrame:
    near = with_neighbours(assigned, "ord")
    alone = ~sum((F.coalesce(F.col(c) == F.col("ord"), F.lit(False)).cast("int") for c in ("left", "right", "top", "bottom")), F.lit(0)).cast("boolean")
    return near.groupBy("image_id").agg(F.sum(alone.cast("long")).alias("n"))


def _stripes(assigned: DataFrame) -> DataFrame:
    near = with_neighbours(assigned, "ord")
    inner = F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("top").isNotNull() & F.col("bottom").isNotNull()
    across = F.when(inner & (F.col("left") == F.col("right")) & (F.col("left") != F.col("ord")), F.col("left"))
    along = F.when(inner & (F.col("top") == F.col("bottom")) & (F.col("top") != F.col("ord")), F.col("top"))
    return near.select(*CELL, "ord", across.alias("across"), along.alias("along"))


def thin_stripes(assigned: DataFrame) -> DataFrame:
    return _stripes(assigned).groupBy("image_id").agg(F.sum((F.col("across").isNotNull() | F.col("along").isNotNull()).cast("long")).alias("n"))


def cleaned_stripes(assigned: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Stripe cells take the colour on both sides; where the two directions disagree they stay."""
    agree = F.col("across").eqNullSafe(F.col("along"))
    one = F.when(F.col("along").isNull(), F.col("across")).when(F.col("across").isNull(), F.col("along")).when(agree, F.col("across"))
    weight = F.when(agree, 2).otherwise(1)
    return _stripes(assigned).select(*CELL, F.when(one.isNotNull() & (penalty * weight > 0.5), one).otherwise(F.col("ord")).alias("ord"))


def cleaned_alias(assigned: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Inner cells take a colour that at least six of eight neighbours have, if at most one side neighbour is like them.

    The three cells across, then the three rows of these, are windows of one clustering by image.
    """
    rows, columns = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    across = assigned.repartition("image_id").select(*CELL, "ord", F.lag("ord").over(rows).alias("l"), F.lead("ord").over(rows).alias("r"))
    near = across.select(*CELL, "ord", "l", "r", *(f(c).over(columns).alias(f"{n}_{c}") for n, f in (("t", F.lag), ("b", F.lead)) for c in ("ord", "l", "r")))
    around = F.array("l", "r", *(f"{n}_{c}" for n in "tb" for c in ("ord", "l", "r")))
    times = lambda v: F.size(F.filter(around, lambda o: o == v))
    top = F.array_max(F.transform(F.array_distinct(around), lambda v: F.struct(times(v).alias("n"), (-v).alias("other"))))
    sides = sum(((F.col(c) == F.col("ord")).cast("int") for c in ("l", "r", "t_ord", "b_ord")), F.lit(0))
    inner = F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("t_ord").isNotNull() & F.col("b_ord").isNotNull()
    best = near.select(*CELL, "ord", inner.alias("inner"), F.when(inner, top).alias("top"), sides.alias("sides"), times(F.col("ord")).alias("like"))
    dominant = -F.col("top.other")
    moves = F.col("inner") & (dominant != F.col("ord")) & (F.col("top.n") >= 6) & (F.col("sides") <= 1) & (penalty * (F.col("top.n") - F.col("like")) > 1)
    return best.select(*CELL, F.when(moves, dominant).otherwise(F.col("ord")).alias("ord"))


# Masks (value v in 0..1)


def mask_boundary(mask: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Foreground cells with a 4-neighbour that is background or outside."""
    near = with_neighbours(mask.select(*CELL, (F.col("v") >= threshold).alias("on")), "on")
    closed = F.lit(True)
    for c in ("left", "right", "top", "bottom"):
        closed = closed & F.coalesce(F.col(c), F.lit(False))
    return near.select(*CELL, (F.col("on") & ~closed).alias("boundary"))


def dilated(mask: DataFrame, threshold: float = 0.5) -> DataFrame:
    """3 x 3 dilation: rows, then columns."""
    on = mask.select(*CELL, (F.col("v") >= threshold).cast("int").alias("on"))
    frame = lambda by, order: Window.partitionBy("image_id", by).orderBy(order).rowsBetween(-1, 1)
    rows = on.select(*CELL, F.max("on").over(frame("y", "x")).alias("on"))
    return rows.select(*CELL, F.max("on").over(frame("x", "y")).alias("on"))


def boundary_fit(mask: DataFrame, distances: DataFrame, threshold: float = 0.5, band: float = 1.25) -> DataFrame:
    """image_id, iou and distance: how the boundary of a mask (widened by one cell) meets the cells within `band` of a signed
    distance field's zero, and the mean distance of its cells from there as a share of the diagonal. 1 and 0 without a boundary."""
    edge = mask_boundary(mask, threshold)
    wide = dilated(edge.select(*CELL, F.col("boundary").cast("double").alias("v")))
    both = edge.join(wide, CELL).join(distances.select(*CELL, F.abs("distance").alias("far")), CELL)
    near, target = F.coalesce(F.col("far") <= band, F.lit(False)), F.col("on") == 1
    either = F.sum((near | target).cast("int"))
    sums = both.groupBy("image_id").agg(
        F.when(either > 0, F.sum((near & target).cast("int")) / either).otherwise(1.0).alias("iou"), F.avg(F.when(F.col("boundary"), F.col("far"))).alias("far"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")
    )
    diagonal = F.greatest(F.lit(1.0), F.sqrt((F.col("w") * F.col("w") + F.col("h") * F.col("h")).cast("double")))
    return sums.select("image_id", "iou", F.coalesce(clamped(F.col("far") / diagonal, 0.0, 1.0), F.lit(0.0)).alias("distance"))


def coverage_raster(mask: DataFrame, source: int, target: int, threshold: float = 0.5) -> DataFrame:
    """image_id, x, y, coverage, active; if no cell reaches the threshold, the strongest covered one is active."""
    cover = resize_area(mask, source, target, ["v"]).withColumnRenamed("v", "coverage")
    image = Window.partitionBy("image_id")
    top = F.row_number().over(image.orderBy(F.desc("coverage"), "y", "x")) == 1
    none = ~F.max(F.col("coverage") >= threshold).over(image)
    return cover.select(*CELL, "coverage", ((F.col("coverage") >= threshold) | (none & top & (F.col("coverage") > 0))).alias("active"))


def coverage_iou(one: DataFrame, other: DataFrame) -> DataFrame:
    """image_id, iou of two value masks; 1 if both are empty."""
    both = one.select(*CELL, F.col("v").alias("p")).join(other.select(*CELL, F.col("v").alias("q")), CELL)
    low, high = F.sum(F.least("p", "q")), F.sum(F.greatest("p", "q"))
    return both.groupBy("image_id").agg(F.when(high > 0, low / high).otherwise(1.0).alias("iou"))


def subject_box(mask: DataFrame, threshold: float = 0.5, padding: float = 0.04) -> DataFrame:
    """image_id, x, y, width, height of the padded bounding box of the foreground; images without one are left out."""
    on = F.col("v") >= threshold
    ends = {f"{f.__name__}_{c}": f(F.when(on, F.col(c))) for f in (F.min, F.max) for c in "xy"}
    box = mask.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), *(v.alias(k) for k, v in ends.items())).where("min_x is not null")
    pad = rounded(F.greatest("w", "h") * padding)
    x, y = F.greatest(F.lit(0), F.col("min_x") - pad), F.greatest(F.lit(0), F.col("min_y") - pad)
    right, bottom = F.least(F.col("w"), F.col("max_x") + pad + 1), F.least(F.col("h"), F.col("max_y") + pad + 1)
    return box.select("image_id", x.cast("long").alias("x"), y.cast("long").alias("y"), (right - x).cast("long").alias("width"), (bottom - y).cast("long").alias("height"))


def mask_certainty(mask: DataFrame) -> DataFrame:
    certain = clamped(F.avg(F.abs(F.col("v") - 0.5) * 2), 0.0, 1.0)
    return mask.groupBy("image_id").agg(F.when(F.max("v") >= 0.5, certain).otherwise(0.0).alias("certainty"))


def boundary_importance(mask: DataFrame) -> DataFrame:
    near = with_neighbours(mask.select(*CELL, "v"), "v")
    step = F.greatest(F.lit(0.0), *(F.coalesce(F.abs(F.col("v") - F.col(c)), F.lit(0.0)) for c in ("left", "right", "top", "bottom")))
    return near.select(*CELL, clamped(F.col("v") * 0.55 + step * 0.75, 0.0, 1.0).alias("weight"))


def landmark_falloff(pixels: DataFrame, landmarks: DataFrame, radius: int) -> DataFrame:
    """image_id, x, y, importance: the largest falloff of the landmarks around; each is sent to the cells it reaches."""
    axis = F.sequence(F.lit(-radius), F.lit(radius))
    sent = landmarks.select("image_id", "x", "y", "confidence", "priority", F.explode(axis).alias("dx")).select("*", F.explode(axis).alias("dy"))
    far = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    strength = F.greatest(F.lit(0.0), 1 - far / (radius + 1)) * F.col("confidence") * F.when(F.col("priority") == "hard", 1.0).otherwise(0.75)
    spots = sent.select("image_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), strength.alias("s")).groupBy(*CELL).agg(F.max("s").alias("s"))
    return pixels.select(*CELL).join(spots, CELL, "left").select(*CELL, F.coalesce("s", F.lit(0.0)).alias("importance"))


def value_levels(pixels: DataFrame, levels: int = 3) -> DataFrame:
    """Pixels moved to the nearest of their hue group's luminance quantiles; groups smaller than `levels` stay."""
    lit = pixels.select(*CELL, *"rgb", color.hue_bucket(*map(F.col, "rgb")).alias("hue"), color.luminance(*map(F.col, "rgb")).alias("l"))
    group = Window.partitionBy("image_id", "hue")
    ranked = lit.select("*", F.row_number().over(group.orderBy("l")).alias("nth"), F.count("*").over(group).alias("n"))
    place = lambda k: F.floor((F.col("n") - 1) * (k / (levels - 1)) + 0.5) + 1
    near = ranked.select("*", *(F.max(F.when(F.col("nth") == place(k), F.col("l"))).over(group).alias(f"level{k}") for k in range(levels)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"level{k}") - F.col("l")).alias("d"), F.lit(k).alias("k"), F.col(f"level{k}").alias("t")) for k in range(levels))))
    delta = F.when(F.col("n") < levels, 0.0).otherwise(best["t"] - F.col("l"))
    return near.select(*CELL, *(clamped(rounded(F.col(c) + delta), 0, 255).cast("int").alias(c) for c in "rgb"))


def levelled(image: np.ndarray, rgb: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """`value_levels` of rows in memory. image: the number of each row's image; levels: how many its image has."""
    light, hue = color.luminance_rows(rgb), color.hue_rows(rgb)
    order = np.lexsort((light, hue, image))
    new = np.concatenate([[True], (np.diff(image[order]) != 0) | (np.diff(hue[order]) != 0)])
    starts = np.flatnonzero(new)
    start, n = np.empty(len(rgb), np.int64), np.empty(len(rgb), np.int64)
    group = np.cumsum(new) - 1
    start[order], n[order] = starts[group], np.diff([*starts, len(rgb)])[group]
    least, delta, ranked = np.full(len(rgb), np.inf), np.zeros(len(rgb)), light[order]
    for k in range(int(levels.max())):
        at = start + np.floor((n - 1) * (k / (levels - 1)) + 0.5).astype(np.int64)
        target = ranked[np.where(k < levels, at, start)]
        closer = (k < levels) & (np.abs(target - light) < least)
        least, delta = np.where(closer, np.abs(target - light), least), np.where(closer, target - light, delta)
    return np.clip(np.floor(rgb + np.where(n < levels, 0.0, delta)[:, None] + 0.5), 0, 255).astype(np.int64)
