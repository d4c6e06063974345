"""Resampling of images of any size: crop, fit on a canvas, nearest, bilinear or area, transparency over a background."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import color, scalars

WHITE = (255, 255, 255)
#: How a cell is made: of the nearest pixel, of the four around its centre, or of all that it covers.
NEAREST, LINEAR, COVERED = range(3)
_GEOMETRY = ("width", "height", "how", *(f"{s}{n}" for s in "cf" for n in "xywh"))
#: Pairs of a pixel and a cell are weighed so many at a time.
AT_ONCE = 1 << 20


def _taps(at: dict[str, np.ndarray], axis: str, side: str) -> tuple[np.ndarray, ...]:
    """(image, source place, cell, weight) along one axis of each image, sorted by image and place. at: geometry, one value an image."""
    of = lambda n: at[n].astype(np.int64)
    cells = of(f"f{side}")
    image = np.repeat(np.arange(len(cells)), cells)
    local = np.arange(len(image)) - np.repeat(np.cumsum(cells) - cells, cells)
    start, size, how = of(f"c{axis}")[image], of(f"c{side}")[image], of("how")[image]
    center = start + (local + 0.5) * size / cells[image] - 0.5
    step = size / cells[image]
    low, high = start + local * step, np.minimum(start + size, start + (local + 1) * step)
    first = np.floor(np.select([how == NEAREST, how == LINEAR], [center + 0.5, center], low)).astype(np.int64)
    count = np.select([how == NEAREST, how == LINEAR], [1, 2], np.ceil(high).astype(np.int64) - first)
    tap = np.repeat(np.arange(len(image)), count)
    nth = np.arange(len(tap)) - np.repeat(np.cumsum(count) - count, count)
    place, share = first[tap] + nth, (center - first)[tap]
    covered = np.minimum(high[tap], place + 1) - np.maximum(low[tap], place)
    weight = np.select([how[tap] == NEAREST, how[tap] == LINEAR], [1.0, np.where(nth == 0, 1 - share, share)], covered)
    image = image[tap]
    place = np.clip(place, 0, of({"w": "width", "h": "height"}[side])[image] - 1)
    order = np.lexsort((place, image))
    return image[order], place[order], (of(f"f{axis}")[image] + local[tap])[order], weight[order]


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weights and weighted colours in the cells that a batch's pixels touch; an image's sums may come in parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("image_id").dictionary_encode()
        image = names.indices.to_numpy()
        first = np.unique(image, return_index=True)[1]
        at = {n: batch.column(n).to_numpy()[first] for n in _GEOMETRY}
        rgb = [batch.column(c).to_numpy() for c in "rgb"]
        found = []
        for axis, side in (("x", "w"), ("y", "h")):
            own, place, cell, weight = _taps(at, axis, side)
            stride = int(place.max()) + 2
            keys, wanted = own * stride + place, image * stride + np.minimum(batch.column(axis).to_numpy().astype(np.int64), stride - 1)
            begin = np.searchsorted(keys, wanted)
            found.append((begin, np.searchsorted(keys, wanted, "right") - begin, cell, weight))
        (bx, nx, cx, wx), (by, ny, cy, wy) = found
        touched = np.cumsum(nx * ny)
        cut = np.searchsorted(touched, np.arange(AT_ONCE, int(touched[-1]) + AT_ONCE, AT_ONCE)) + 1
        for a, b in zip([0, *cut], [*cut, len(nx)], strict=True):
            n = (nx * ny)[a:b]
            row = np.repeat(np.arange(a, a + len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            if not len(row):
                continue
            tx, ty = bx[row] + nth // ny[row], by[row] + nth % ny[row]
            wide, high = int(cx.max()) + 1, int(cy.max()) + 1
            cell, number = np.unique((image[row].astype(np.int64) * high + cy[ty]) * wide + cx[tx], return_inverse=True)
            weight = wx[tx] * wy[ty]
            sums = [np.bincount(number, weight if c is None else weight * c[row], len(cell)) for c in (None, *rgb)]
            values = [names.dictionary.take(pa.array(cell // (high * wide))), pa.array(cell % wide, pa.int32()), pa.array(cell // wide % high, pa.int32()), *(pa.array(v) for v in sums)]
            yield pa.RecordBatch.from_arrays(values, names=["image_id", "gx", "gy", "weight", *"rgb"])


def fitted(frames: DataFrame) -> DataFrame:
    """frames (width, height, cx, cy, cw, ch, tw, th) with c, the crop within the image, and f, its place on the canvas."""
    crop = scalars.whole_crop(*map(F.col, ("width", "height", "cx", "cy", "cw", "ch")))
    return frames.withColumn("c", crop).withColumn("f", scalars.fit_crop(F.col("c.width"), F.col("c.height"), F.col("tw"), F.col("th")))


def resized(frames: DataFrame, pixels: DataFrame, background: tuple[int, int, int] = WHITE) -> DataFrame:
    """image_id, x, y, active, r, g, b: each frame's canvas by its method (nearest, bilinear, area; what enlarges is bilinear).

    Pixels (r, g, b, a) lie over the background before they are mixed; cells outside the fit are background and not active.
    A frame shows the pixels of its image, or of the image that its column own names, if there. Each pixel is sent to the cells
    that it touches, those of a batch together, and only sums of cells are shuffled. The result is dealt by image_id, and sorted by y and x.
    """
    placed = fitted(frames)
    how = F.when(F.col("method") == "nearest", NEAREST).when((F.col("method") == "bilinear") | (F.col("c.width") < F.col("f.width")) | (F.col("c.height") < F.col("f.height")), LINEAR).otherwise(COVERED)
    sides = [(f"{s}{n}", F.col(f"{s}.{long}")) for s in "cf" for n, long in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))]
    known = {"width": F.col("width"), "height": F.col("height"), "how": how} | dict(sides)
    geometry = placed.select(F.col("own" if "own" in frames.columns else "image_id").alias("source"), "image_id", *(known[n].cast("int").alias(n) for n in _GEOMETRY))
    # A null channel adds nothing to a sum.
    flat = pixels.where("x is not null and y is not null").select(F.col("image_id").alias("source"), "x", "y", *(F.coalesce(color.composited(F.col(c), F.col("a"), F.lit(float(back))).cast("double"), F.lit(0.0)).alias(c) for c, back in zip("rgb", background, strict=True)))
    kind = frames.select("image_id").schema[0].dataType.simpleString()
    parts = flat.join(geometry, "source").select("image_id", "x", "y", *"rgb", *_GEOMETRY).mapInArrow(_sent, f"image_id {kind}, gx int, gy int, weight double, r double, g double, b double")
    # Frames and sums are dealt by frame, as whoever streams through rasters needs them; a frame's row becomes its cells after that.
    dealt = placed.select("image_id", "tw", "th", "f").unionByName(parts, allowMissingColumns=True).repartition("image_id")
    axis = lambda size, own: F.explode(F.coalesce(F.sequence(F.lit(0), (F.col(size) - 1).cast("int")), F.array(own))).alias(own)
    both = dealt.select("image_id", "th", "f", axis("tw", "gx"), "gy", "weight", *"rgb").select("image_id", "f", "gx", axis("th", "gy"), "weight", *"rgb")
    inside = (F.col("gx") >= F.col("f.x")) & (F.col("gy") >= F.col("f.y")) & (F.col("gx") < F.col("f.x") + F.col("f.width")) & (F.col("gy") < F.col("f.y") + F.col("f.height"))
    # The largest of structs is found in sorted groups, in the order that streams need; hash maps of single values held a partition twice.
    groups = both.groupBy("image_id", F.col("gy").alias("y"), F.col("gx").alias("x"))
    sums = groups.agg(F.max(F.struct(inside.alias("active"))).alias("at"), *(F.sum(c).alias(c) for c in ("weight", *"rgb"))).withColumn("active", F.col("at.active"))
    mixed = lambda c: color.rounded(F.round(F.col(c) / F.nullif(F.col("weight"), F.lit(0.0)), 9))  # noqa: E731  # ties don't hang on the order of the sum
    return sums.where("active is not null").select("image_id", "x", "y", "active", *(F.coalesce(mixed(c), F.lit(back)).cast("int").alias(c) for c, back in zip("rgb", background, strict=True)))
