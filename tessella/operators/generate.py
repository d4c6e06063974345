"""Patterns from images: for each image, canvas and style a candidate; candidates are measured, scored and ranked.

A candidate is an image of its own to the grid operators: its id takes the place of the image's. Rasters are made of pixels
that stream past their frames; candidates are dealt by raster and stream through their steps, many of one size side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import color, scalars
from tessella.functions.color import STYLES
from tessella.operators import cleanup, editing, features, kernels, measures, planning, raster, relaxation, resize
from tessella.operators.raster import CELL

#: What a baseline resolves to: resize method, colour distance, whether grids are cleaned, and whether labels are smoothed.
BASELINES = {"a0": ("nearest", "delta-e-76", False, False), "a1": ("area", "delta-e-2000", True, False), "mvp": ("area", "delta-e-2000", True, True)}


@dataclass(frozen=True)
class Options:
    """How patterns are made; the defaults are those of the engine."""

    sizes: tuple[tuple[int, int], ...]
    styles: tuple[str, ...] = ("faithful", "simple", "high-contrast")
    max_colors: int = 24
    baseline: str = "mvp"
    most: int = 5

    def resolved(self) -> tuple[tuple[str, ...], tuple[tuple[int, int], ...]]:
        """Styles (only faithful but in mvp) and canvases, each once, the canvases by area, width and height."""
        styles = tuple(dict.fromkeys(self.styles)) if self.baseline == "mvp" else ("faithful",)
        return styles, tuple(sorted(set(self.sizes), key=lambda s: (s[0] * s[1], *s)))


def candidates(frames: DataFrame, pixels: DataFrame, palette: DataFrame, options: Options, landmarks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidate cells: image_id (the candidate's), x, y, ord; measures: one row for each candidate).

    frames: image_id, width, height and crop (cx, cy, cw, ch). pixels: image_id, x, y, r, g, b, a. landmarks: image_id, landmark_id, kind,
    x, y (pixels), confidence, priority, grid_radius, symmetry_group; hard ones are spared by smoothing and clean-up, all weigh
    colours around them, and a candidate that hides a hard one isn't valid.
    """
    method, _, cleans, _ = BASELINES[options.baseline]
    styles, sizes = options.resolved()
    colors = raster.palette_rows(palette)
    size = F.explode(F.array(*(F.struct(F.lit(w).alias("tw"), F.lit(h).alias("th")) for w, h in sizes)))
    variants = frames.select("*", size.alias("s")).select("*", "s.tw", "s.th", F.lit(method).alias("method")).drop("s")
    # One raster for each image and canvas: its number stands for the image while it is made.
    canvas = F.element_at(F.create_map(*(F.lit(v) for k, (w, h) in enumerate(sizes) for v in (f"{w}x{h}", k))), F.concat_ws("x", "tw", "th"))
    numbered = variants.withColumns({"own": F.col("image_id"), "image_id": F.col("image_id") * len(sizes) + canvas})
    made = resize.resized(numbered, pixels).where("active").drop("active")
    marks = None
    if landmarks is not None:
        # Where landmarks are doesn't hang on the style, nor do the cells that they lift and protect.
        marks, spots = (_placed(landmarks, resize.fitted(numbered), n) for n in (len(styles), 1))
        made = made.join(planning.lifted_cells(spots), CELL, "left").withColumn("weight", planning.cell_weight(F.lit(0.0))).drop("lift")
        if cleans:
            held = features.held_cells(spots).distinct().withColumn("protected", F.lit(True))
            made = made.join(held, CELL, "left").withColumn("protected", F.coalesce("protected", F.lit(False)))
    # Each style of a raster is a candidate; those of one raster stay in its partition, and rasters without landmarks in the one that they were made in.
    dealt = made.where("image_id is not null").repartition("image_id")
    number = F.col("image_id").cast("long").alias("image_id")
    if len(styles) > 1:  # one style keeps the order, too
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(styles) - 1))).alias("k"))
        number = (F.col("image_id") * len(styles) + F.col("k")).cast("long").alias("image_id")
    more = [c for c in ("weight", "protected") if c in made.columns]
    streamed = dealt.select(number, "x", "y", *"rgb", *more).sortWithinPartitions("image_id", "y", "x").mapInArrow(_patterned(colors, options, styles), _PATTERNED)
    both = _settled(streamed.select(*CELL, "ord", F.struct(*(F.col(f"plan_{c}").alias(c) for c in "rgb")).alias("plan"), F.struct(*"rgb").alias("raw")))
    assigned = both.select(*CELL, "ord")
    out = measures.measured(both.select(*CELL, "ord", "plan", F.col("raw").alias("source")), colors, dealt=True)
    out = out.join(_reference(frames, pixels, resize.fitted(numbered), assigned, colors, len(sizes) * len(styles), len(styles)), "image_id")
    if marks is None:
        out = out.withColumns({"feature": F.lit(0.0), "confidence": F.lit(0.0), "valid": F.lit(True), "reasons": F.lit("")})
    else:
        at_marks = both.select(*CELL, "raw.*")
        cells = assigned.withColumn("region", F.lit(None).cast("int"))
        seen = features.visibility(_settled(features.evaluated(_settled(marks), cells, at_marks, palette))).select("image_id", F.col("score").alias("feature"), "confidence", "valid", "reasons")
        out = out.join(seen, "image_id", "left").fillna(0.0, ["feature", "confidence"]).fillna("", ["reasons"]).withColumn("valid", F.coalesce("valid", F.lit(True)))
    number, k = F.floor(F.col("image_id") / len(styles)), F.col("image_id") % len(styles)
    style = F.element_at(F.array(*map(F.lit, styles)), (k + 1).cast("int"))
    named = out.select(F.floor(number / len(sizes)).cast("long").alias("own"), F.element_at(F.array(*(F.lit(f"{w}x{h}") for w, h in sizes)), (number % len(sizes) + 1).cast("int")).alias("size"), style.alias("style"), *out.columns)
    return assigned, _settled(named.withColumnRenamed("image_id", "candidate").withColumnRenamed("own", "image_id"))


def _placed(landmarks: DataFrame, fitted: DataFrame, styles: int) -> DataFrame:
    """landmarks in the cells of each candidate of their image, those outside its crop left out."""
    c = F.col
    places = fitted.select(c("own"), c("image_id").alias("number"), "c", "f")
    both = landmarks.join(places, landmarks["image_id"] == c("own"))
    inside = (c("x") >= c("c.x")) & (c("y") >= c("c.y")) & (c("x") < c("c.x") + c("c.width")) & (c("y") < c("c.y") + c("c.height"))
    scale = F.greatest(c("f.width") / c("c.width"), c("f.height") / c("c.height"))
    source = c("source_radius").cast("double") if "source_radius" in landmarks.columns else F.lit(None).cast("double")
    radius = scalars.landmark_radius(c("grid_radius").cast("double"), source, scale)
    cell = scalars.grid_cell(c("c"), c("f"), c("x"), c("y"))
    style = F.explode(F.sequence(F.lit(0), F.lit(styles - 1)))
    rows = both.where(inside).select((c("number") * styles).alias("first"), "landmark_id", "kind", "confidence", "priority", "symmetry_group", radius.cast("int").alias("grid_radius"), cell.alias("cell")).select("*", style.alias("k"))
    return rows.select((c("first") + c("k")).alias("image_id"), "landmark_id", "kind", "confidence", "priority", "symmetry_group", "grid_radius", c("cell.x").cast("int").alias("x"), c("cell.y").cast("int").alias("y"))


def _reference(frames: DataFrame, pixels: DataFrame, fitted: DataFrame, assigned: DataFrame, colors: list[dict], each: int, styles: int) -> DataFrame:
    """image_id (the candidate's), reference and reference_edges: each candidate beside its image's reference raster."""
    side = F.lit(measures.REFERENCE_SIDE)
    full = resize.fitted(frames.withColumns({"tw": side, "th": side}))
    # A crop within the raster's side is seen pixel by pixel and laid out beside the candidates; a larger one shrinks to the raster.
    small = (F.col("c.width") <= side) & (F.col("c.height") <= side)
    wanted = full.withColumns({"tw": F.when(small, F.col("c.width")).otherwise(side).cast("int"), "th": F.when(small, F.col("c.height")).otherwise(side).cast("int"), "method": F.when(small, "nearest").otherwise("area")})
    seen = resize.resized(wanted.drop("c", "f"), pixels).where("active")
    # What is the same for all cells of a candidate goes ahead of them in one row: where the crop lies on its canvas and on the raster.
    laid = resize.fitted(fitted.withColumns({"own_fit": F.col("f"), "tw": side, "th": side}))
    candidate = F.explode(F.sequence(F.col("image_id") * styles, F.col("image_id") * styles + (styles - 1))).alias("candidate")
    places = [*(F.col(f"own_fit.{n}").alias(f"f{c}") for n, c in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))), *(F.when(small, F.col(f"c.{n}")).otherwise(0).alias(f"r{n}") for n in "xy"), *(F.col(f"f.{n}").alias(f"r{n[0]}") for n in ("width", "height"))]
    fits = laid.select(F.col("own").alias("image_id"), candidate, *places)
    cells = assigned.select(F.floor(F.col("image_id") / each).alias("image_id"), F.col("image_id").alias("candidate"), "x", "y", "ord").unionByName(fits, allowMissingColumns=True)
    beside = measures.beside_reference(seen, cells, colors)
    return beside.select(F.col("candidate").alias("image_id"), F.col("distance").alias("reference"), F.col("agreement").alias("reference_edges"))


def _settled(df: DataFrame) -> DataFrame:
    """df in the shared checkpoint folder, if one is set: what follows reads it many times."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


_PATTERNED = "image_id long, x int, y int, r int, g int, b int, ord int, plan_r int, plan_g int, plan_b int"
#: Numbers of a matrix of distances that a task makes at least, of whole candidates, so that candidates of one size meet.
AT_ONCE = 1_200_000


def _patterned(palette: list[dict], options: Options, styles: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over a raster's cells sorted by candidate: the candidate's style, levels of lightness, the colours that a candidate may use, each cell's nearest of these, smoothing and clean-up.

    All these look at distances of the same cells to the same colours, so the distances are made once. The rows keep their order.
    """
    _, metric, cleans, smooths = BASELINES[options.baseline]
    palette = sorted(palette, key=lambda p: p["ord"])
    ords, labs = np.array([p["ord"] for p in palette], np.int64), raster.palette_labs(palette)
    known = np.array([[p[c] for c in "rgb"] for p in palette], np.int64).reshape(-1, 3)
    limits = np.array([color.style_color_limit(min(options.max_colors, len(palette)), s) for s in styles])
    # Two levels of lightness for the simple style, three for others.
    levels = np.array([2 if s == "simple" else 3 for s in styles])
    late = 1.0 if options.baseline == "mvp" else 0.0
    penalties = cleanup.Penalties(stripe=late, alias=late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in relaxation.whole_images(batches, AT_ONCE // max(1, len(palette))):
            ids = table.column("image_id").to_numpy()
            turns = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
            cells = np.diff([*turns, len(ids)])
            if cells.max() > kernels.MOST_CELLS:
                raise ValueError(f"a grid has at most {kernels.MOST_CELLS} cells")
            image, style = np.repeat(np.arange(len(turns)), cells), ids[turns] % len(styles)
            raw = np.stack([table.column(c).to_numpy() for c in "rgb"], axis=1).astype(np.int64)
            rgb = np.empty_like(raw)
            for k, name in enumerate(styles):
                rgb[(style == k)[image]] = color.styled_rows(raw[(style == k)[image]], name)
            if smooths:
                rgb = raster.levelled(image, rgb, levels[style][image])
            own = color.lab_rows(rgb)
            far, weight = color.MATRICES[metric](own, labs), relaxation._numbers(table, "weight", 1.0)
            picks = raster.greedy_picks(far, weight, turns, int(limits.max()))
            allowed = np.zeros((len(turns), len(ords)), bool)
            np.put_along_axis(allowed, picks, np.arange(picks.shape[1]) < limits[style][:, None], axis=1)
            allowed[limits[style] >= len(ords)] = True
            cost = ((rgb[:, None] - known) ** 2).sum(axis=2).astype(np.float64) if options.baseline == "a0" else far
            cost = np.where(allowed[image], cost, np.inf)
            labels = cost.argmin(axis=1)
            protected = relaxation._numbers(table, "protected", False).astype(bool)
            if smooths:
                cost *= (relaxation.OWN + relaxation.LIFT * weight)[:, None]
            if smooths or cleans:
                for rows, nth, y, x, shape in relaxation._stacks(table):
                    at = (nth, y, x)
                    grid = lambda values, outside: relaxation._grid(rows, at, shape, values, outside)  # noqa: E731, B023
                    now = grid(labels, -1)
                    if smooths:
                        now, _ = relaxation.smoothed(grid(own, 0.0), now, grid(cost, 0.0), grid(~protected, False))
                    if cleans:
                        now = cleanup.cleaned_grids(now, grid(protected, False), penalties)
                    labels[rows] = now[at]
            values = [pa.array(ords[labels], pa.int32()), *(pa.array(c, pa.int32()) for c in rgb.T)]
            yield from pa.table([*(table.column(c) for c in (*CELL, *"rgb")), *values], names=[c.split()[0] for c in _PATTERNED.split(", ")]).to_batches()

    return run


def ranked(measured: DataFrame, options: Options, frames: DataFrame | None = None) -> DataFrame:
    """The best candidates of each image: nth, image_id, size, style, total, valid, and status of the image (success or best-effort).

    Images of `frames` without a candidate have one row, of the status no-valid-candidate.
    """
    c = F.col
    of = {
        "source": c("source"), "reference": c("reference"), "plan": c("plan"), "structure": 0.3 * c("source_edges") + 0.2 * c("plan_edges") + 0.5 * c("reference_edges"), "feature": c("feature"), "confidence": c("confidence"),
        "isolated": c("isolated"), "stripes": c("stripes"), "cells": c("cells"), "colors": c("colors"), "canvas": 1 / (1 + c("cells") / 1024),
    }
    total = F.lit(0.0)
    for name, style in STYLES.items():
        total = F.when(c("style") == name, editing.score(of, name, options.max_colors, style[4])).otherwise(total)
    scored = measured.withColumns({"total": F.round(total, 9), "candidate_id": F.concat_ws(":", "size", "style")})
    best = planning.ranked(scored, options.most)
    images = None if frames is None else frames.select("image_id").distinct()
    status = planning.statuses(best, images)
    return best.join(status, "image_id", "right").select("image_id", "nth", "size", "style", "total", "valid", "status")
