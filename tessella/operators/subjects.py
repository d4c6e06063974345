"""Subject masks without a model: the alpha channel, else what a flood from the border doesn't reach."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import cleanup
from tessella.operators.shapes import MOST_PIXELS

#: The channels' weights in a colour distance, and the alpha below which an image counts as transparent.
WEIGHTS, OPAQUE = (0.3, 0.59, 0.11), 0.98
MOST_SURE, LEAST_SHARE, MOST_SHARE, DOUBT = 0.92, 0.01, 0.95, 0.35


def _flooded(threshold: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        if group.num_rows > MOST_PIXELS:
            raise ValueError(f"an image has at most {MOST_PIXELS} pixels")
        group = group.sort_by([("y", "ascending"), ("x", "ascending")])
        w, h = (int(group.column(c).to_numpy().max()) + 1 for c in "xy")
        image = np.stack([group.column(c).to_numpy().astype(float).reshape(h, w) for c in "rgb"])
        corners = image[:, [0, 0, -1, -1], [0, -1, 0, -1]].mean(axis=1)
        far = np.sqrt(sum(k * (image[c] - corners[c]) ** 2 for c, k in enumerate(WEIGHTS)))
        ring = np.ones((h, w), bool)
        ring[1:-1, 1:-1] = False
        # All regions of the ground are labelled at once; those that touch the border are what the flood reaches.
        ids = cleanup.component_ids(np.where(far <= threshold, 0, -1))
        touching = np.zeros(h * w, bool)
        touching[ids[ring & (ids >= 0)]] = True
        reached = (ids >= 0) & touching[ids]
        share = float((~reached).mean())
        sure = min(MOST_SURE, float(reached[ring].mean()) * (1 if LEAST_SHARE < share < MOST_SHARE else DOUBT))
        return pa.table({**{c: group.column(c) for c in ("image_id", "x", "y")}, "v": pa.array((~reached).ravel().astype(float)), "confidence": pa.array(np.full(w * h, sure))})

    return run


def inferred(pixels: DataFrame, threshold: float = 30.0) -> DataFrame:
    """image_id, x, y, v, confidence and source: alpha where any pixel is transparent, else border-flood. One image is one group."""
    clear = pixels.groupBy("image_id").agg(F.max(F.col("a") / 255 < OPAQUE).alias("has_alpha"))
    both = pixels.join(clear, "image_id")
    alpha = both.where("has_alpha").select("image_id", "x", "y", (F.col("a") / 255).alias("v"), F.lit(1.0).alias("confidence"), F.lit("alpha").alias("source"))
    solid = both.where("not has_alpha").select("image_id", "x", "y", *"rgb").groupBy("image_id").applyInArrow(_flooded(threshold), "image_id long, x int, y int, v double, confidence double")
    return alpha.union(solid.withColumn("source", F.lit("border-flood")))
