"""Measures of candidate patterns: distances, edges and grid quality in one pass, and how they look beside a reference raster.

A candidate's cells are dealt and sorted once and stream through tasks, candidates of one size side by side; no measure has a
shuffle of its own. The reference raster of an image is followed by all of the image's candidates in one stream, so colours of the
reference are compared with the palette once an image. A raster that repeats the pixels of a smaller crop comes as the crop's
pixels: no row is made for a repeated cell, and a pair of a pixel and a cell that the raster repeats is looked at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.operators import raster, relaxation

#: Colours that differ by so much make an edge.
EDGE = 12.0
REFERENCE_SIDE = 96
#: Rows of whole images that a task holds at least, so that images of one size meet.
AT_ONCE = 40_000
_MEASURED = "image_id long, cells long, colors long, plan double, source double, plan_edges double, source_edges double, isolated long, stripes long"


def agreement(labs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each image: sides between active cells at which edges of colours and of labels agree, and all such sides."""
    agree, pairs = np.zeros(len(labels), np.int64), np.zeros(len(labels), np.int64)
    for one, other in ((np.s_[:, :, :-1], np.s_[:, :, 1:]), (np.s_[:, :-1], np.s_[:, 1:])):
        both = (labels[one] >= 0) & (labels[other] >= 0)
        edge = ((labs[one] - labs[other]) ** 2).sum(axis=-1) >= EDGE**2
        agree += (both & (edge == (labels[one] != labels[other]))).sum(axis=(1, 2))
        pairs += both.sum(axis=(1, 2))
    return agree, pairs


def edges(labs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one image: where colours make an edge towards the right, and downwards."""
    return tuple(((a - b) ** 2).sum(axis=-1) >= EDGE**2 for a, b in ((labs[:, :-1], labs[:, 1:]), (labs[:-1], labs[1:])))


def laid_out(cells: int, pixels: int, start: int) -> np.ndarray:
    """For each cell along one side of a raster the pixel of a crop (from `start` on, so many pixels) that is nearest to its centre."""
    return np.clip(np.floor(start + (np.arange(cells) + 0.5) * pixels / cells - 0.5 + 0.5).astype(int) - start, 0, pixels - 1)


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(1, whole), 1.0)


def quality(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each image: cells like none of their sides, and inner cells between two of one other label."""
    wide = np.pad(labels, ((0, 0), (1, 1), (1, 1)), constant_values=-1)
    left, right, top, bottom = wide[:, 1:-1, :-2], wide[:, 1:-1, 2:], wide[:, :-2, 1:-1], wide[:, 2:, 1:-1]
    inside = labels >= 0
    alone = inside & (left != labels) & (right != labels) & (top != labels) & (bottom != labels)
    inner = inside & (left >= 0) & (right >= 0) & (top >= 0) & (bottom >= 0)
    stripe = inner & (((left == right) & (left != labels)) | ((top == bottom) & (top != labels)))
    return alone.sum(axis=(1, 2)), stripe.sum(axis=(1, 2))


def measured(cells: DataFrame, palette: list[dict], dealt: bool = False) -> DataFrame:
    """One row a candidate (see _MEASURED). cells: image_id, x, y, ord, and the colours plan and source (structs of r, g, b) that it stands for.

    dealt: each candidate's rows follow one another in one partition, as a stream over rasters leaves them, so they aren't dealt and sorted again.
    """
    palette = sorted(palette, key=lambda p: p["ord"])
    ords, known = np.array([p["ord"] for p in palette], np.int64), raster.palette_labs(palette)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in relaxation.whole_images(batches, AT_ONCE):
            ids = table.column("image_id").to_numpy()
            labels = np.searchsorted(ords, table.column("ord").to_numpy())
            labs = {k: color.lab_rows(np.stack([table.column(f"{k}_{c}").to_numpy() for c in "rgb"], axis=1)) for k in ("plan", "source")}
            far = {k: color.e2000_rows(v, known[labels]) for k, v in labs.items()}
            for rows, image, y, x, shape in relaxation._stacks(table):
                at, n = (image, y, x), shape[0]
                grid = relaxation._grid(rows, at, shape, labels, -1)
                count = np.bincount(image, minlength=n)
                used = np.zeros((n, len(ords)), bool)
                used[image, labels[rows]] = True
                edges = {k: share(*agreement(relaxation._grid(rows, at, shape, v, 0.0), grid)) for k, v in labs.items()}
                means = {k: np.bincount(image, v[rows], minlength=n) / count for k, v in far.items()}
                alone, stripes = quality(grid)
                names = ids[rows[np.searchsorted(image, np.arange(n))]]
                values = [names, count, used.sum(axis=1), means["plan"], means["source"], edges["plan"], edges["source"], alone, stripes]
                kinds = [pa.int64()] * 3 + [pa.float64()] * 4 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _MEASURED.split(", ")])

    flat = cells.select(F.col("image_id").cast("long").alias("image_id"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "ord", *(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("plan", "source") for c in "rgb"))
    return (flat.where("image_id is not null") if dealt else relaxation._sorted(flat)).mapInArrow(run, _MEASURED)


@lru_cache(maxsize=4096)
def _axis(cells: int, pixels: int, start: int | None, origin: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Along one side of a raster of so many cells: the pairs of a pixel and a candidate's cell, in order, and how often each is repeated.

    start: as in `laid_out`; without one, the raster's cells are the pixels. The candidate fills `size` cells from origin on.
    """
    own = np.arange(cells) if start is None else laid_out(cells, pixels, start)
    under = origin + np.minimum(size - 1, np.floor((np.arange(cells) + 0.5) / cells * size).astype(int))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(under) != 0)]))
    return own[first], under[first], np.diff([*first, cells])


def _beside(far: np.ndarray, labs: np.ndarray, labels: np.ndarray, across: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and agreement of candidates with one fit, (candidates, height, width) of pairs; far and labs are those of the pairs' pixels.

    across and along: how often each row and column of pairs is repeated. A step within repeats has neither an edge of colours nor of labels.
    """
    under, times = labels >= 0, along[:, None] * across
    seen = (under * times).sum(axis=(1, 2))
    own = np.take_along_axis(np.broadcast_to(far, (len(labels), *far.shape)), np.maximum(labels, 0)[..., None], axis=3)[..., 0]
    mean = np.where(seen > 0, (own * under * times).sum(axis=(1, 2)) / np.maximum(1, seen), 0.0)
    agree = (under * ((along - 1)[:, None] * across + along[:, None] * (across - 1))).sum(axis=(1, 2))
    pairs = agree.copy()
    right, down = edges(labs)
    for edge, one, other, weight in ((right, labels[:, :, :-1], labels[:, :, 1:], along[:, None]), (down, labels[:, :-1], labels[:, 1:], across)):
        both = (one >= 0) & (other >= 0)
        agree += ((both & (edge == (one != other))) * weight).sum(axis=(1, 2))
        pairs += (both * weight).sum(axis=(1, 2))
    return mean, share(agree, pairs)


def beside_reference(reference: DataFrame, cells: DataFrame, palette: list[dict]) -> DataFrame:
    """image_id, candidate, distance and agreement of each candidate with its image's reference raster.

    reference: image_id, x, y, r, g, b of active cells (they fill a rectangle). cells: image_id, candidate, x, y, ord, and the place of the
    candidate's canvas that the same crop fills (fx, fy, fw, fh), in all its rows or in one without a cell (ord null). 0 and 1 for a candidate
    without cells under the reference. With columns rx, ry, rw, rh in cells, the reference is a crop of pixels that starts at (rx, ry), and its raster repeats the nearest of them on rw x rh cells.
    """
    palette = sorted(palette, key=lambda p: p["ord"])
    ords, known = np.array([p["ord"] for p in palette], np.int64), raster.palette_labs(palette)
    repeats = "rw" in cells.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in relaxation.whole_images(batches, AT_ONCE, sys.maxsize):
            v = {c: table.column(c).fill_null(0).to_numpy() for c in table.column_names}
            ids, kind, made = v["image_id"], v["kind"], table.column("ord").is_valid().to_numpy()
            pixel = np.flatnonzero(kind == 0)
            labs = color.lab_rows(np.stack([v[c][pixel] for c in "rgb"], axis=1))
            far, labels = color.e2000_matrix(labs, known), np.searchsorted(ords, v["ord"])
            out: list[tuple] = []
            turns = np.flatnonzero((np.diff(ids) != 0) | (np.diff(v["candidate"]) != 0) | (np.diff(kind) != 0)) + 1
            parts = [(a, b) for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(ids)], strict=True) if kind[a] == 0 or made[b - 1]]
            place, nth = None, 0
            for k, (a, b) in enumerate(parts):
                if kind[a] == 0:
                    x, y = v["x"][a:b], v["y"][a:b]
                    place = np.full((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1), nth)
                    place[y - y.min(), x - x.min()] = np.arange(nth, nth + b - a)
                    shown, nth = ids[a], nth + b - a
                    waiting: list[tuple[int, int]] = []
                    continue
                if place is None or shown != ids[a]:
                    continue  # without a reference
                waiting.append((a + int(np.count_nonzero(~made[a:b])), b))
                # Candidates that follow one another with one fit are looked at together.
                fit = tuple(int(v[c][a]) for c in ("fx", "fy", "fw", "fh"))
                if k + 1 < len(parts):
                    after = parts[k + 1][0]
                    if ids[after] == ids[a] and kind[after] == 1 and fit == tuple(int(v[c][after]) for c in ("fx", "fy", "fw", "fh")):
                        continue
                rx, ry, rw, rh = (int(v[c][a]) for c in ("rx", "ry", "rw", "rh")) if repeats else (None, None, *place.shape[::-1])
                px, cx, nx = _axis(rw, place.shape[1], rx, fit[0], fit[2])
                py, cy, ny = _axis(rh, place.shape[0], ry, fit[1], fit[3])
                rows = np.concatenate([np.arange(*w) for w in waiting])
                grid = np.full((len(waiting), max(fit[1] + fit[3], int(v["y"][rows].max()) + 1), max(fit[0] + fit[2], int(v["x"][rows].max()) + 1)), -1)
                grid[np.repeat(np.arange(len(waiting)), [d - c for c, d in waiting]), v["y"][rows], v["x"][rows]] = labels[rows]
                under = place[np.ix_(py, px)]
                mean, agreed = _beside(far[under], labs[under], grid[:, cy[:, None], cx], nx, ny)
                out += [(ids[a], v["candidate"][c], m, g) for (c, _), m, g in zip(waiting, mean.tolist(), agreed.tolist(), strict=True)]
                waiting = []
            kinds = {"image_id": pa.int64(), "candidate": pa.int64(), "distance": pa.float64(), "agreement": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    whole = lambda *columns: [F.col(c).cast("int").alias(c) for c in columns]
    image, none = F.col("image_id").cast("long").alias("image_id"), lambda kind, *columns: [F.lit(None).cast(kind).alias(c) for c in columns]
    fits = ("fx", "fy", "fw", "fh", *(("rx", "ry", "rw", "rh") if repeats else ()))
    left = reference.select(image, F.lit(0).alias("kind"), *none("long", "candidate"), *whole("x", "y", *"rgb"), *none("int", "ord", *fits))
    right = cells.select(image, F.lit(1).alias("kind"), F.col("candidate").cast("long").alias("candidate"), *whole("x", "y"), *none("int", *"rgb"), *whole("ord", *fits))
    # A row without a cell, which has the fit, comes first of its candidate's.
    both = left.union(right).where("image_id is not null").repartition("image_id").sortWithinPartitions("image_id", "kind", "candidate", "ord")
    return both.mapInArrow(run, "image_id long, candidate long, distance double, agreement double")
