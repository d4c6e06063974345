"""Shapes of subjects on grids: a model of the source mask, its raster on a canvas, and a boundary search that lowers an energy.

An image's mask and its variants (crop, canvas, sweeps) meet in one group: the mask is shuffled once, whatever the number of variants.
A variant's coverage is a product of two matrices of overlaps, its distances are bilinear samples of the mask's signed distance.
The search then flips single cells near the boundary, in raster order, as long as that lowers the energy. The change that a flip
makes depends on the cells around it only, so all changes are held in one grid and brought up to date near each flip;
components and holes are counted anew only for flips that can change them (where the cell is no simple point) and would pay otherwise.

A mask has at most `MOST_PIXELS` pixels and a canvas at most `kernels.MOST_CELLS` cells. Rows with a null image id are left out;
an image without foreground has no variants.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars
from tessella.operators import cleanup, kernels

MOST_PIXELS = 1 << 22
#: What is foreground; weights of wrong sides, of the boundary's distance, of lonely and of single-sided cells, and of topology.
THRESHOLD, WRONG, BOUNDARY, LONELY, SINGLE, TOPOLOGY = 0.5, 0.35, 0.25, 0.8, 0.12, 1.5
#: Distances count up to FAR; cells within NEAR of the boundary, or covered in part, may flip; so many sweeps may be asked for.
FAR, NEAR, PART, MOST_SWEEPS = 2.0, 1.5, (0.05, 0.95), 32
EPSILON = 1e-9
#: Fixed value: cells so near to the boundary's distance are compared with a variant's own boundary.
BAND = 1.25

_CELLS = "active array<boolean>, coverage array<float>, distance array<float>, protected array<boolean>"
SCHEMA = f"image_id long, key string, width int, height int, {_CELLS}, allocated array<struct<landmark_id: string, x: int, y: int, cells: int>>, reference_components int, components int, reference_holes int, holes int, edits int, energy_before double, energy_after double"


def sides(active: np.ndarray) -> np.ndarray:
    """How many of its four sides each cell shares with an active one."""
    wide = np.pad(active, 1).astype(np.int8)
    return wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:]


def _own(active: np.ndarray, coverage: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The part of a cell's energy that only it decides."""
    wrong = np.where(active, -distance, distance)
    return np.abs(active - coverage) + WRONG * np.clip(wrong, 0, FAR)


def _among(count: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """What an active cell with so many active sides adds."""
    return (count < 4) * BOUNDARY * np.minimum(FAR, np.abs(distance)) + (count == 0) * LONELY + (count == 1) * SINGLE


def topology(active: np.ndarray) -> tuple[int, int]:
    """(components over sides, holes: background over sides and corners that doesn't reach the border)."""
    # A component's name is the place of its first cell. Cells less shared sides plus full squares of four are components less holes.
    parts = int((cleanup.component_ids(np.where(active, 0, -1)).ravel() == np.arange(active.size)).sum())
    across = active[:, :-1] & active[:, 1:]
    whole = np.count_nonzero(active) - np.count_nonzero(across) - np.count_nonzero(active[:-1] & active[1:]) + np.count_nonzero(across[:-1] & across[1:])
    return parts, parts - int(whole)


def energy(active: np.ndarray, coverage: np.ndarray, distance: np.ndarray, components: int, holes: int, found: tuple[int, int] | None = None) -> float:
    """Of a whole mask; components and holes are those that it should have, found is the mask's topology if it is known."""
    parts, gaps = topology(active) if found is None else found
    return float(_own(active, coverage, distance).sum() + (active * _among(sides(active), distance)).sum()) + TOPOLOGY * (abs(parts - components) + abs(gaps - holes))


def flip_changes(active: np.ndarray, coverage: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """How the energy changes if a cell flips, for each cell, but for topology."""
    count = sides(active)
    now = _among(count, distance)
    turned = _own(~active, coverage, distance) - _own(active, coverage, distance) + np.where(active, -now, now)
    more, fewer = (np.pad(active * (_among(count + step, distance) - now), 1) for step in (1, -1))
    beside = lambda grid: grid[:-2, 1:-1] + grid[2:, 1:-1] + grid[1:-1, :-2] + grid[1:-1, 2:]
    return turned + np.where(active, beside(fewer), beside(more))


def simple(active: np.ndarray, y: int, x: int) -> bool:
    """Whether a flip leaves the numbers of components and holes as they are: one run of sides around the cell."""
    ring = [active[y + dy, x + dx] if 0 <= y + dy < active.shape[0] and 0 <= x + dx < active.shape[1] else False for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))]
    return sum(bool(ring[k]) and not (ring[k + 1] and ring[(k + 2) % 8]) for k in (0, 2, 4, 6)) == 1


def boundary_band(active: np.ndarray) -> np.ndarray:
    """Active cells with a side that isn't, widened by one cell all around."""
    wide = np.pad(active & (sides(active) < 4), 1)
    rows = wide[:-2] | wide[1:-1] | wide[2:]
    return rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:]


def refined(active: np.ndarray, coverage: np.ndarray, distance: np.ndarray, protected: np.ndarray, components: int, holes: int, sweeps: int, found: tuple[int, int] | None = None) -> tuple[np.ndarray, int]:
    """(mask, flips) after at most so many sweeps over the cells near the boundary of the first mask, whose topology is found, if it is known."""
    active = active.copy()
    if not sweeps:
        return active, 0
    candidate = boundary_band(active) | ((coverage > PART[0]) & (coverage < PART[1])) | (np.abs(distance) <= NEAR)
    order = np.flatnonzero((candidate & ~protected).ravel())
    changes = flip_changes(active, coverage, distance)
    parts, gaps = topology(active) if found is None else found
    flips = 0
    for _ in range(sweeps):
        before, at = flips, -1
        while True:
            # One flip joins or parts at most four components or holes.
            most = TOPOLOGY * (min(3, abs(parts - components)) + min(3, abs(gaps - holes)))
            ahead = order[np.searchsorted(order, at, side="right") :]
            paying = np.flatnonzero(changes.ravel()[ahead] - most + EPSILON < 0)
            if not len(paying):
                break
            at = int(ahead[paying[0]])
            y, x = divmod(at, active.shape[1])
            change, turned = changes[y, x], (parts, gaps)
            active[y, x] = ~active[y, x]
            if not simple(active, y, x):
                turned = topology(active)
                change += TOPOLOGY * (abs(turned[0] - components) - abs(parts - components) + abs(turned[1] - holes) - abs(gaps - holes))
            if change + EPSILON >= 0:
                active[y, x] = ~active[y, x]
                continue
            parts, gaps = turned
            flips += 1
            # Flips up to two cells away have changed; they look two cells further.
            top, left = max(0, y - 4), max(0, x - 4)
            part = flip_changes(*(g[top : y + 5, left : x + 5] for g in (active, coverage, distance)))
            own, inner = (slice(max(0, y - 2), y + 3), slice(max(0, x - 2), x + 3)), (slice(max(0, y - 2) - top, y + 3 - top), slice(max(0, x - 2) - left, x + 3 - left))
            changes[own] = part[inner]
        if flips == before:
            break
    return active, flips


def overlaps(start: float, length: float, cells: int, pixels: int) -> np.ndarray:
    """(cells, pixels): the share of a cell that each pixel covers, along one side; cells divide `length` pixels from `start` on."""
    edges = start + np.arange(cells + 1) * (length / cells)
    low, high = edges[:-1, None], edges[1:, None]
    at = np.arange(pixels)[None, :]
    shared = np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None)
    # Beyond the mask its edge repeats.
    shared[:, 0] += np.clip(np.minimum(high[:, 0], 0) - low[:, 0], 0, None)
    shared[:, -1] += np.clip(high[:, 0] - np.maximum(low[:, 0], pixels), 0, None)
    return shared / shared.sum(axis=1, keepdims=True)


def signed_distances(on: np.ndarray) -> np.ndarray:
    """To the nearest pixel of the other class, positive inside; without one, a little more than the diagonal."""
    most = float(on.shape[0] ** 2 + on.shape[1] ** 2 + 1)
    inside, outside = (np.sqrt(kernels.squared_distance(t)) if t.any() else np.full(on.shape, np.sqrt(most)) for t in (~on, on))
    return np.where(on, inside, -outside).astype(np.float32)


def projected(field: np.ndarray, crop: dict, fit: dict, width: int, height: int) -> np.ndarray:
    """Signed distances at the cells of a canvas, in cells; far outside beyond the fitted crop."""
    out = np.full((height, width), -np.hypot(width, height), np.float32)
    scale = max(1e-6, (crop["width"] / fit["width"] + crop["height"] / fit["height"]) / 2)
    at = [np.clip(crop[c] + (np.arange(fit[s]) + 0.5) * crop[s] / fit[s] - 0.5, 0, n - 1) for c, s, n in (("y", "height", field.shape[0]), ("x", "width", field.shape[1]))]
    (top, left), (bottom, right) = ([np.floor(v).astype(int) for v in at], [np.minimum(np.floor(v).astype(int) + 1, n - 1) for v, n in zip(at, field.shape, strict=True)])
    ty, tx = (at[0] - top)[:, None], (at[1] - left)[None, :]
    values = field.astype(np.float64)
    row = lambda r: values[np.ix_(r, left)] * (1 - tx) + values[np.ix_(r, right)] * tx
    out[fit["y"] : fit["y"] + fit["height"], fit["x"] : fit["x"] + fit["width"]] = (row(top) * (1 - ty) + row(bottom) * ty) / scale
    return out


def _allocated(marks: list[dict], crop: dict, fit: dict, active: np.ndarray) -> tuple[np.ndarray, list[dict], int]:
    """(protected cells, allocations, cells added to `active`) of the discs of landmarks within the crop."""
    protected, found, edits = np.zeros(active.shape, bool), [], 0
    height, width = active.shape
    for m in marks:
        if not (crop["x"] <= m["x"] < crop["x"] + crop["width"] and crop["y"] <= m["y"] < crop["y"] + crop["height"]):
            continue
        x, y = (fit[c] + min(fit[s] - 1, max(0, int(np.floor((m[c] - crop[c]) / crop[s] * fit[s])))) for c, s in (("x", "width"), ("y", "height")))
        scale = max(fit["width"] / crop["width"], fit["height"] / crop["height"])
        radius = m["grid_radius"] if m["grid_radius"] is not None else (m["source_radius"] or 0.0) * scale
        radius = max(0, int(np.floor(radius + 0.5)))
        dy, dx = np.mgrid[:height, :width] - np.array([y, x])[:, None, None]
        disc = np.hypot(dy, dx) <= radius + 0.25
        disc &= (np.abs(dy) <= radius) & (np.abs(dx) <= radius)
        edits += int((disc & ~active).sum())
        active |= disc
        protected |= disc
        found.append({"landmark_id": m["landmark_id"], "x": x, "y": y, "cells": int(disc.sum())})
    return protected, found, edits


def variant(values: np.ndarray, field: np.ndarray, asked: dict) -> dict:
    """One variant's raster: masks are rows of values in 0..1, the field their signed distances."""
    crop, fit, width, height = asked["crop"], asked["fit"], asked["width"], asked["height"]
    if width * height > kernels.MOST_CELLS:
        raise ValueError(f"a grid has at most {kernels.MOST_CELLS} cells")
    coverage = np.zeros((height, width), np.float32)
    rows, columns = overlaps(crop["y"], crop["height"], fit["height"], values.shape[0]), overlaps(crop["x"], crop["width"], fit["width"], values.shape[1])
    coverage[fit["y"] : fit["y"] + fit["height"], fit["x"] : fit["x"] + fit["width"]] = np.clip(rows @ values @ columns.T, 0, 1)
    active = coverage >= THRESHOLD
    if not active.any() and coverage.max() > 0:
        active.ravel()[coverage.argmax()] = True
    components, holes = topology(active)
    distance = projected(field, crop, fit, width, height)
    protected, allocated, edits = _allocated(asked["marks"] or [], crop, fit, active)
    own = coverage.astype(np.float64), distance.astype(np.float64)
    found = topology(active) if edits else (components, holes)
    before = energy(active, *own, components, holes, found)
    after, flips = refined(active, *own, protected, components, holes, asked["sweeps"], found)
    parts, gaps = topology(after) if flips else found
    return {
        "image_id": asked["image_id"], "key": asked["key"], "width": width, "height": height, "active": after.ravel(), "coverage": coverage.ravel(), "distance": distance.ravel(), "protected": protected.ravel(), "allocated": allocated,
        "reference_components": components, "components": parts, "reference_holes": holes, "holes": gaps, "edits": edits + flips, "energy_before": before, "energy_after": energy(after, *own, components, holes, (parts, gaps)),
    }


def _finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column.cast("double")) & (F.abs(column.cast("double")) < float("inf"))


def keyed(variants: DataFrame) -> DataFrame:
    """Each variant once, with its fit on the canvas and a key; a wrong one fails the query.

    variants: image_id, cx, cy, cw, ch (the crop in pixels), width, height, sweeps, and a revision of the image's mask if it can change.
    """
    c = F.col
    revision = c("revision").cast("string") if "revision" in variants.columns else F.lit("")
    crop = F.struct(*(c(f"c{k}").cast("double").alias(n) for k, n in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))))
    rows = variants.where(c("image_id").isNotNull()).select(
        c("image_id").cast("long").alias("image_id"), revision.alias("revision"), crop.alias("crop"), *(c(n).cast("int").alias(n) for n in ("width", "height", "sweeps"))
    )
    sound = _finite(c("crop.x")) & _finite(c("crop.y")) & _finite(c("crop.width")) & _finite(c("crop.height")) & (c("crop.width") > 0) & (c("crop.height") > 0)
    whole = (c("width") > 0) & (c("height") > 0) & c("sweeps").between(0, MOST_SWEEPS)
    parts = F.concat_ws("|", c("image_id"), F.coalesce("revision", F.lit("")), c("crop.x"), c("crop.y"), c("crop.width"), c("crop.height"), c("width"), c("height"), c("sweeps"))
    wrong = F.raise_error(F.concat(F.lit("a variant needs a finite crop with sides above 0, whole sides of its canvas above 0, and 0 to 32 sweeps: "), parts))
    key = F.when(F.coalesce(sound & whole, F.lit(False)), F.sha2(parts, 256)).otherwise(wrong.cast("string"))
    fit = scalars.fit_crop(c("crop.width"), c("crop.height"), c("width").cast("double"), c("height").cast("double"))
    whole_fit = F.struct(*(fit[n].cast("int").alias(n) for n in ("x", "y", "width", "height")))
    return rows.withColumn("key", key).dropDuplicates(["key"]).select("*", whole_fit.alias("fit"))


def hard_marks(landmarks: DataFrame) -> DataFrame:
    """image_id and marks: the landmarks whose discs a shape must hold (x and y in pixels; a radius in cells, or one in pixels)."""
    c = F.col
    radius = [(c(n).cast("double") if n in landmarks.columns else F.lit(None).cast("double")).alias(n) for n in ("grid_radius", "source_radius")]
    held = landmarks.where((c("priority") == "hard") & (c("confidence") >= 0.5) & c("affects_occupancy"))
    mark = F.struct(c("landmark_id"), c("x").cast("double").alias("x"), c("y").cast("double").alias("y"), *radius)
    return held.groupBy(c("image_id").cast("long").alias("image_id")).agg(F.array_sort(F.collect_list(mark)).alias("marks"))


def rasterised(masks: DataFrame, asked: DataFrame, landmarks: DataFrame | None = None, counted=None) -> DataFrame:
    """One row a variant (see SCHEMA) of `keyed` ones. masks: image_id, x, y, v. `counted` is an accumulator of the variants made."""
    marks = hard_marks(landmarks) if landmarks is not None else None
    full = asked.withColumn("marks", F.lit(None).cast("array<struct<landmark_id: string, x: double, y: double, grid_radius: double, source_radius: double>>")) if marks is None else asked.join(marks, "image_id", "left")
    kinds = pa.schema([
        ("image_id", pa.int64()), ("key", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("active", pa.list_(pa.bool_())), ("coverage", pa.list_(pa.float32())), ("distance", pa.list_(pa.float32())), ("protected", pa.list_(pa.bool_())),
        ("allocated", pa.list_(pa.struct([("landmark_id", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("cells", pa.int32())]))), *((n, pa.int32()) for n in ("reference_components", "components", "reference_holes", "holes", "edits")),
        ("energy_before", pa.float64()), ("energy_after", pa.float64()),
    ])

    def run(mask: pa.Table, wanted: pa.Table) -> pa.Table:
        if not mask.num_rows or not wanted.num_rows:
            return kinds.empty_table()
        if mask.num_rows > MOST_PIXELS:
            raise ValueError(f"a mask has at most {MOST_PIXELS} pixels")
        x, y = mask.column("x").to_numpy(), mask.column("y").to_numpy()
        values = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
        values[y, x] = mask.column("v").to_numpy()
        on = values >= THRESHOLD
        if not on.any():
            return kinds.empty_table()
        field = signed_distances(on)
        rows = [variant(values, field, asked) for asked in wanted.to_pylist()]
        if counted is not None:
            counted.add(len(rows))
        return pa.Table.from_pydict({n: [r[n] for r in rows] for n in kinds.names}, kinds)

    left = masks.select(F.col("image_id").cast("long").alias("image_id"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("v").cast("double").alias("v"))
    return left.groupBy("image_id").cogroup(full.groupBy("image_id")).applyInArrow(run, SCHEMA)


def variant_cells(variants: DataFrame) -> DataFrame:
    """key, image_id, x, y, active, coverage, distance and protected of each cell."""
    cells = F.posexplode(F.arrays_zip("active", "coverage", "distance", "protected")).alias("place", "c")
    flat = variants.select("key", "image_id", "width", cells)
    return flat.select("key", "image_id", (F.col("place") % F.col("width")).cast("int").alias("x"), F.floor(F.col("place") / F.col("width")).cast("int").alias("y"), "c.*")


def _kept(active: list, coverage: list, distance: list, width: int) -> tuple[float, float, float, float]:
    """How one variant keeps its shape; rows come in small pickled batches, so that few variants are held at once."""
    on = np.array(active, bool).reshape(-1, width)
    cover, far = np.array(coverage, np.float64).reshape(on.shape), np.abs(np.array(distance, np.float64)).reshape(on.shape)
    near, band, edge = far <= BAND, boundary_band(on), on & (sides(on) < 4)
    either, high = np.count_nonzero(near | band), np.maximum(cover, on).sum()
    mean = far[edge].mean() / max(1.0, np.hypot(*on.shape)) if edge.any() else 0.0
    return float(np.count_nonzero(near & band) / either if either else 1.0), float(min(1.0, mean)), float(np.minimum(cover, on).sum() / high if high > 0 else 1.0), float(on.mean())


def shape_scores(variants: DataFrame) -> DataFrame:
    """key, image_id, and how well each variant keeps its shape: boundary_iou, boundary_distance, coverage_iou, occupancy, topology and structure.

    A variant's row holds its cells, so scores need no shuffle, and the variants are made once.
    """
    kept = F.udf(_kept, "struct<boundary_iou: double, boundary_distance: double, coverage_iou: double, occupancy: double>", useArrow=False)
    wrong = F.abs(F.col("reference_components") - F.col("components")) + F.abs(F.col("reference_holes") - F.col("holes"))
    told = variants.select("key", "image_id", "width", "height", (1 - F.least(F.lit(1.0), wrong * 0.25)).alias("topology"), kept("active", "coverage", "distance", "width").alias("s"))
    return told.select("key", "image_id", "width", "height", "s.*", "topology", (F.col("s.boundary_iou") * 0.4 + F.col("s.coverage_iou") * 0.4 + F.col("topology") * 0.2).alias("structure"))


class ShapeVariants:
    """A table of variants in a shared folder: each key is made once and appended; later calls reread it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.made = spark.sparkContext.accumulator(0)

    def stored(self) -> DataFrame:
        """All variants so far; of a key that two writers appended, one row."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(place):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path).dropDuplicates(["key"])

    def get(self, masks: DataFrame, variants: DataFrame, landmarks: DataFrame | None = None) -> DataFrame:
        """The rows of the variants, made if the table lacks them. Variants of empty masks have none."""
        asked = keyed(variants)
        new = asked.join(self.stored().select("key"), "key", "left_anti")
        if not new.isEmpty():
            used = masks.join(new.select("image_id").distinct(), "image_id", "left_semi")
            rasterised(used, new, landmarks, self.made).write.mode("append").parquet(self.path)
        return self.stored().join(asked.select("key"), "key", "left_semi")


def shape_models(masks: DataFrame, landmarks: DataFrame | None = None) -> DataFrame:
    """image_id, width, height, area (foreground), components (area, box, touches the border; by area), holes and anchors of each mask."""
    part = pa.struct([("area", pa.int64()), *((n, pa.int32()) for n in ("x", "y", "width", "height")), ("touches", pa.bool_())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if table.num_rows > MOST_PIXELS:
            raise ValueError(f"a mask has at most {MOST_PIXELS} pixels")
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        on = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
        on[y, x] = table.column("v").to_numpy() >= THRESHOLD
        ids = cleanup.component_ids(np.where(on, 0, -1))
        rows, columns = np.nonzero(on)
        names, number = np.unique(ids[rows, columns], return_inverse=True)
        parts = []
        if len(names):
            ends = {}
            for name, value in (("x", columns), ("y", rows)):
                ends[name] = np.full(len(names), on.size), np.full(len(names), -1)
                np.minimum.at(ends[name][0], number, value), np.maximum.at(ends[name][1], number, value)
            area = np.bincount(number)
            for k in np.lexsort((names, -area)).tolist():
                (a, c), (b, d) = ((int(ends[n][0][k]), int(ends[n][1][k])) for n in "xy")
                parts.append({"area": int(area[k]), "x": a, "y": b, "width": c - a + 1, "height": d - b + 1, "touches": a == 0 or b == 0 or c == on.shape[1] - 1 or d == on.shape[0] - 1})
        values = [[key[0].as_py()], [on.shape[1]], [on.shape[0]], [int(on.sum())], [parts], [topology(on)[1]]]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(part), pa.int32())
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["image_id", "width", "height", "area", "components", "holes"])

    left = masks.where(F.col("image_id").isNotNull()).select(F.col("image_id").cast("long").alias("image_id"), "x", "y", F.col("v").cast("double").alias("v"))
    out = left.groupBy("image_id").applyInArrow(run, "image_id long, width int, height int, area long, components array<struct<area: long, x: int, y: int, width: int, height: int, touches: boolean>>, holes int")
    if landmarks is None:
        return out
    held = landmarks.where("affects_occupancy")
    least = scalars.anchor_cells(F.col("priority"), F.col("grid_radius").cast("double"))
    anchor = F.struct("landmark_id", "kind", "x", "y", least.alias("least_cells"), (F.col("priority") == "hard").alias("hard"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))).alias("confidence"))
    return out.join(held.groupBy("image_id").agg(F.array_sort(F.collect_list(anchor)).alias("anchors")), "image_id", "left")
