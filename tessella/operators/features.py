"""Landmark features on a grid: protected cells, budgets on a canvas, and how visible features are in a pattern."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import color, scalars
from tessella.functions.color import clamped
from tessella.operators import planning

#: How a kind is measured, its weight, and the least coverage, purity, connectivity, contrast and boundary of a hard one.
PROFILES = {
    "eye": ("blob", 1.4, 0.75, 0.35, 0.75, 0.2, 0.0),
    "nose": ("blob", 1.0, 0.5, 0.25, 0.5, 0.08, 0.0),
    "identity-mark": ("blob", 1.3, 0.6, 0.3, 0.6, 0.12, 0.0),
    "custom": ("blob", 0.8, 0.5, 0.25, 0.5, 0.1, 0.0),
    "mouth": ("template", 1.2, 0.45, 0.0, 0.45, 0.08, 0.0),
    "ear": ("contour", 0.9, 0.0, 0.0, 0.0, 0.0, 0.12),
    "face-contour": ("contour", 1.1, 0.0, 0.0, 0.0, 0.0, 0.12),
    "body": ("geometry", 0.7, 0.0, 0.0, 0.0, 0.0, 0.0),
}
LEAST_MATCH, FULL_CONTRAST, MATCH_SCALE = 0.35, 24.0, 15.0
#: A landmark moves by at most this many cells, whatever its kind.
SHIFT = 1


def enforced() -> Column:
    """Hard landmarks that are likely enough."""
    return (F.col("priority") == "hard") & (F.col("confidence") >= 0.5)


def _profile(k: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kind, v in PROFILES.items() for x in (kind, v[k]))), F.col("kind"))


def _squares(landmarks: DataFrame, radius: Column) -> DataFrame:
    """landmarks with dx, dy and cx, cy: each sent to the cells of the square around it, for an equi-join."""
    axis = F.explode(F.sequence(-radius, radius))
    wide = landmarks.select("*", axis.alias("dx"))
    return wide.select("*", axis.alias("dy")).withColumns({"cx": F.col("x") + F.col("dx"), "cy": F.col("y") + F.col("dy")})


def held_cells(landmarks: DataFrame) -> DataFrame:
    """image_id, x, y of the cells in the squares of enforced landmarks, active or not."""
    return _squares(landmarks.where(enforced()).select("image_id", "x", "y", "grid_radius"), F.col("grid_radius")).select("image_id", F.col("cx").alias("x"), F.col("cy").alias("y"))


def protected_cells(landmarks: DataFrame, active: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """image_id, x, y of active cells in the squares of enforced landmarks, and of others (cells protected for another reason); each once."""
    held = held_cells(landmarks).join(active.select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi")
    return (held if others is None else held.union(others.select("image_id", "x", "y"))).distinct()


def budgets(landmarks: DataFrame, active: DataFrame, side: int) -> DataFrame:
    """landmarks with allocated cells, capacity, hard, feasible, collision, satisfaction and weight on a canvas of side x side.

    A landmark's cells are its disc, or by scale without a radius; they must be active near it. Hard ones of a symmetry group
    that fall into one cell collide, and none of them is feasible.
    """
    of = lambda k: F.element_at(F.create_map(*(F.lit(x) for kind, v in planning.FEATURES.items() for x in (kind, v[k]))), F.col("kind"))
    by_scale = F.floor(F.pow(F.lit(side) / of(3), F.lit(2.0)) * of(1) + 0.5)
    theory = F.least(of(2), F.greatest(F.lit(1), F.when(F.col("grid_radius").isNotNull(), scalars.disk_cells(F.col("grid_radius").cast("double"))).otherwise(by_scale))).cast("int")
    placed = landmarks.withColumn("theory", theory)
    reach = (SHIFT + F.greatest(F.lit(0), F.ceil((F.sqrt(F.col("theory").cast("double")) - 1) / 2))).cast("int")
    near = _squares(placed.select("image_id", "landmark_id", "x", "y", reach.alias("reach")), F.col("reach")).select("image_id", "landmark_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    capacity = near.join(active.select("image_id", "x", "y"), ["image_id", "x", "y"]).groupBy("image_id", "landmark_id").agg(F.count("*").alias("capacity"))
    whole = active.groupBy("image_id").agg(F.count("*").alias("active_cells"))
    out = placed.join(capacity, ["image_id", "landmark_id"], "left").join(whole, "image_id", "left").fillna(0, ["capacity", "active_cells"])
    out = out.withColumn("allocated", F.when(F.col("kind") == "body", F.least(of(2), F.col("active_cells"))).otherwise(F.least("theory", "capacity")).cast("long")).withColumn("hard", enforced())
    groups = out.where("hard and symmetry_group is not null").groupBy("image_id", "symmetry_group").agg((F.count("*") > F.count_distinct("x", "y")).alias("collides"))
    out = out.join(groups, ["image_id", "symmetry_group"], "left").withColumn("collision", F.col("hard") & F.coalesce("collides", F.lit(False)))
    feasible = (F.col("allocated") >= of(0)) & ~F.col("collision")
    progress = clamped(F.col("allocated") / of(1), 0.0, 1.0)
    satisfied = F.when(~feasible, 0.0).when(F.col("hard"), 0.8 + 0.2 * progress).otherwise(progress)
    weight = of(4) * F.when(F.col("priority") == "hard", 1.25).otherwise(1.0) * F.col("confidence")
    return out.select("image_id", "landmark_id", "kind", "allocated", "capacity", "hard", feasible.alias("feasible"), "collision", satisfied.alias("satisfaction"), weight.alias("weight"))


def budget_scores(rows: DataFrame) -> DataFrame:
    """image_id, score (1 without weight), feasible and reasons of an image's budgets."""
    reason = F.when(F.col("hard") & ~F.col("feasible"), F.when(F.col("collision"), "canvas-hard-feature-collision").otherwise("canvas-hard-feature-underbudget"))
    sums = rows.groupBy("image_id").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * (1 - F.col("satisfaction"))).alias("missed"), F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons"))
    return sums.select("image_id", F.when(F.col("weight") > 0, clamped(1 - F.col("missed") / F.col("weight"), 0.0, 1.0)).otherwise(1.0).alias("score"), (F.col("reasons") == "").alias("feasible"), "reasons")


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column matching replaced by connectivity: the share of a feature's matching cells that its centre reaches over sides."""
    for batch in batches:
        radii, lists = batch.column("grid_radius").to_numpy(), batch.column("matching")
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        dx, dy = (lists.flatten().field(c).to_numpy() for c in ("dx", "dy"))
        shares = np.zeros(len(lists))
        for r in np.unique(radii).tolist():
            own = radii == r
            at = own[row]
            open_ = np.zeros((int(own.sum()), 2 * r + 3, 2 * r + 3), bool)  # closed at the rim
            open_[(np.cumsum(own) - 1)[row[at]], dy[at] + r + 1, dx[at] + r + 1] = True
            reached = np.zeros_like(open_)
            reached[:, r + 1, r + 1] = open_[:, r + 1, r + 1]
            while True:
                wide = reached.copy()
                wide[:, 1:] |= reached[:, :-1]
                wide[:, :-1] |= reached[:, 1:]
                wide[:, :, 1:] |= reached[:, :, :-1]
                wide[:, :, :-1] |= reached[:, :, 1:]
                wide &= open_
                if (wide == reached).all():
                    break
                reached = wide
            shares[own] = reached.sum(axis=(1, 2)) / np.maximum(1, open_.sum(axis=(1, 2)))
        kept = [n for n in batch.schema.names if n not in ("grid_radius", "matching")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(shares, pa.float64())], names=[*kept, "connectivity"])


def evaluated(landmarks: DataFrame, cells: DataFrame, pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """landmarks (x, y: their cell) with area, coverage, purity, connectivity, contrast, boundary, match, score and reasons (comma-joined).

    cells: image_id, x, y, ord, region (or null) of active cells. pixels: the source's colour at each landmark's place.
    A feature is the centre's colour within its square; the ring of cells around the square tells contrast and boundary, contrast
    only to the carrier region: the ring's most frequent one (ties to the smaller), else the centre's, else all.
    """
    key = ["image_id", "landmark_id"]
    lab = palette.select("ord", color.lab(*map(F.col, "rgb")).alias("lab"))
    pairs = lab.toDF("center", "p").join(lab.toDF("ord", "q")).select("center", "ord", color.delta_e2000(F.col("p"), F.col("q")).alias("far"))  # palettes are bounded: raster.MOST_COLORS squared
    seen = landmarks.where("confidence > 0")
    square = _squares(seen.select(*key, "x", "y", "grid_radius"), F.col("grid_radius") + 1).select(*key, "grid_radius", "dx", "dy", F.col("cx").alias("x"), F.col("cy").alias("y"))
    around = square.join(cells, ["image_id", "x", "y"])
    # A landmark's cells are dealt once; what all of them share comes from windows over them.
    whole, region = Window.partitionBy(*key), Window.partitionBy(*key, "region")
    middle, outer = (F.col("dx") == 0) & (F.col("dy") == 0), ~F.col("inside") & F.col("region").isNotNull()
    own = around.withColumn("inside", (F.abs("dx") <= F.col("grid_radius")) & (F.abs("dy") <= F.col("grid_radius")))
    own = own.withColumns({"center": F.max(F.when(middle, F.col("ord"))).over(whole), "center_region": F.max(F.when(middle, F.col("region"))).over(whole), "n": F.count(F.when(outer, 1)).over(region)}).where("center is not null")
    carrier = -F.max(F.when(outer, F.struct("n", (-F.col("region")).alias("r")))).over(whole)["r"]
    told = own.withColumn("same", F.col("ord") == F.col("center")).withColumn("carrier", F.coalesce(carrier, "center_region")).join(F.broadcast(pairs), ["center", "ord"], "left")
    ring = ~F.col("inside")
    neighbour = ring & (F.col("carrier").isNull() | F.col("region").eqNullSafe(F.col("carrier")))
    matching = F.col("inside") & F.col("same")
    sums = told.groupBy(*key, "grid_radius", "center").agg(
        F.sum(F.col("inside").cast("int")).alias("cells"), F.sum(matching.cast("int")).alias("area"), F.avg(F.when(neighbour, F.coalesce("far", F.lit(0.0)))).alias("far"), F.avg(F.when(ring, (~F.col("same")).cast("int"))).alias("boundary"),
        F.collect_list(F.when(matching, F.struct("dx", "dy"))).alias("matching"),
    )
    kept = sums.drop("grid_radius", "matching")
    connected = sums.mapInArrow(_connected, kept.withColumn("connectivity", F.lit(0.0)).schema)
    source = landmarks.select(*key, "x", "y").join(pixels, ["image_id", "x", "y"]).select(*key, color.lab(*map(F.col, "rgb")).alias("source"))
    out = seen.join(connected, key, "left").join(source, key, "left").join(F.broadcast(lab.withColumnRenamed("ord", "center")), "center", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    least = F.when(F.col("grid_radius") == 0, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("cells") * 0.4)))
    out = out.withColumns({
        "coverage": zero(clamped(F.col("area") / least, 0.0, 1.0)), "purity": zero(F.col("area") / F.greatest(F.lit(1), F.col("cells"))), "connectivity": zero(F.col("connectivity")),
        "contrast": zero(clamped(F.col("far") / FULL_CONTRAST, 0.0, 1.0)), "boundary": zero(F.col("boundary")), "match": zero(1 / (1 + color.delta_e2000(F.col("source"), F.col("lab")) / MATCH_SCALE)),
    })
    missing, c = F.col("center").isNull(), F.col
    tests = {
        "hard-feature-area": (c("coverage") < _profile(2)) | (c("purity") < _profile(3)), "hard-feature-boundary": c("boundary") < _profile(6), "hard-feature-fragmented": c("connectivity") < _profile(4),
        "hard-feature-low-contrast": c("contrast") < _profile(5), "hard-feature-source-mismatch": (_profile(0) != "geometry") & (c("match") < LEAST_MATCH),
    }
    reasons = F.concat_ws(",", *(F.when(enforced() & ~missing & t, name) for name, t in tests.items()), F.when(enforced() & missing, "hard-feature-missing"))
    score = (
        F.when(missing, 0.0).when(_profile(0) == "geometry", 1.0).when(_profile(0) == "contour", c("match") * (0.75 * c("boundary") + 0.25 * c("contrast")))
        .when(_profile(0) == "template", c("match") * (0.2 * c("coverage") + 0.3 * c("connectivity") + 0.25 * c("contrast") + 0.25 * c("boundary")))
        .otherwise(c("match") * (0.25 * c("coverage") + 0.2 * c("purity") + 0.2 * c("connectivity") + 0.35 * c("contrast")))
    )
    return out.select(*key, "kind", "priority", "confidence", "symmetry_group", "x", "y", F.coalesce("area", F.lit(0)).alias("area"), "coverage", "purity", "connectivity", "contrast", "boundary", "match", score.alias("score"), reasons.alias("reasons"))


def visibility(rows: DataFrame) -> DataFrame:
    """One row for each image: score, confidence and means (weighed by confidence, hardness and kind), valid and reasons.

    Members of a symmetry group should stand in cells of their own and be of one size; enforced ones in one cell collide.
    """
    weighed = rows.withColumn("w", F.col("confidence") * F.when(F.col("priority") == "hard", 1.5).otherwise(1.0) * _profile(1)).withColumn("hard", enforced())
    mean = lambda c: F.when(F.sum("w") > 0, F.sum(F.col(c) * F.col("w")) / F.sum("w")).otherwise(0.0)
    means = weighed.groupBy("image_id").agg(*(mean(c).alias(c) for c in ("score", "confidence", "coverage", "purity", "connectivity", "contrast")), F.array_distinct(F.flatten(F.collect_list(F.split("reasons", ",")))).alias("reasons"))
    grouped = weighed.where("symmetry_group is not null").groupBy("image_id", "symmetry_group").agg(
        F.count("*").alias("n"), F.count_distinct("x", "y").alias("places"), F.min("area").alias("least"), F.max("area").alias("most"), F.count(F.when(F.col("hard"), 1)).alias("n_hard"), F.count_distinct(F.when(F.col("hard"), F.struct("x", "y"))).alias("hard_places")
    )
    even = F.when(F.col("n") > 1, F.col("places") / F.col("n") * (F.col("least") / F.greatest(F.lit(1), F.col("most"))))
    groups = grouped.groupBy("image_id").agg(F.avg(even).alias("symmetry"), F.max((F.col("n_hard") > 1) & (F.col("hard_places") < F.col("n_hard"))).alias("collides"))
    out = means.join(groups, "image_id", "left")
    total = clamped(0.85 * F.col("score") + 0.15 * F.coalesce("symmetry", "score"), 0.0, 1.0)
    told = F.array_sort(F.filter(F.concat("reasons", F.when(F.coalesce("collides", F.lit(False)), F.array(F.lit("hard-feature-collision"))).otherwise(F.array().cast("array<string>"))), lambda r: r != ""))
    return out.select("image_id", total.alias("score"), "confidence", "coverage", "purity", "connectivity", "contrast", (F.size(told) == 0).alias("valid"), F.array_join(told, ",").alias("reasons"))
