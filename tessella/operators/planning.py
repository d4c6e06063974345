"""Planning and choosing: canvas sizes and budgets, cell regions and weights, candidate scores and ranks, adaptation, rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.functions.color import clamped
from tessella.operators.editing import score

#: Least, preferred and most cells of a feature, its scale, and its weight.
FEATURES = {
    "eye": (1, 2, 4, 32, 1.5),
    "mouth": (1, 3, 6, 28, 1.25),
    "nose": (1, 1, 3, 40, 0.65),
    "ear": (1, 3, 8, 26, 0.9),
    "face-contour": (4, 12, 24, 20, 1.2),
    "body": (4, 12, 32, 18, 0.7),
    "identity-mark": (1, 3, 8, 26, 1.3),
    "custom": (1, 2, 6, 30, 0.8),
}
MOST_BEADS = 9216


def canvas_plans(coverage: DataFrame, sizes: list[int], feature: Column | None = None) -> DataFrame:
    """image_id, size, beads, subject, composition, total from image_id and subject share, centroid x and y (0..1)."""
    size = F.explode(F.array(*map(F.lit, sorted(set(sizes)))))
    rows = coverage.select("image_id", "share", "cx", "cy", (F.lit(1.0) if feature is None else feature).alias("feature"), size.alias("size"))
    beads = F.col("size") * F.col("size")
    cost = beads / float(MOST_BEADS)
    subject = clamped(1 - F.abs(F.col("share") - 0.55) / 0.55, 0.0, 1.0) * 0.45 + 0.55
    dx, dy = F.col("cx") - 0.5, F.col("cy") - 0.48
    composition = clamped(1 - F.sqrt(dx * dx + dy * dy) / 0.6, 0.0, 1.0)
    total = clamped(0.38 * F.col("feature") + 0.18 * subject + 0.16 * composition + 0.28 - 0.3 * cost - 0.1 * F.sqrt(cost), 0.0, 1.0)
    return rows.select("image_id", "size", beads.cast("long").alias("beads"), subject.alias("subject"), composition.alias("composition"), total.alias("total"))


def feature_budgets(landmarks: DataFrame, size: Column) -> DataFrame:
    """landmarks with allocated cells (by the kind's scale, at most the kind's most) and whether they suffice."""
    of = lambda k: F.create_map(*(F.lit(x) for name, v in FEATURES.items() for x in (name, v[k])))[F.col("kind")]
    by_scale = F.floor(size * size / (of(3) * of(3)) * of(1) + 0.5)
    allocated = F.least(of(2), F.greatest(F.lit(1), by_scale)).cast("long")
    return landmarks.select("*", allocated.alias("allocated"), of(0).cast("long").alias("least"), (allocated >= of(0)).alias("feasible"), (of(4) * F.when(F.col("priority") == "hard", 1.25).otherwise(1.0) * F.col("confidence")).alias("weight"))


def region_ids(regions: DataFrame, least: float = 0.4) -> DataFrame:
    """image_id, x, y, region: for each cell the region of the largest value times confidence above `least`, ties to the smaller ord."""
    strong = regions.withColumn("s", F.col("v") * F.col("confidence")).where(F.col("s") > least)
    return strong.groupBy("image_id", "x", "y").agg(F.max(F.struct("s", (-F.col("ord")).alias("ord"))).alias("top")).select("image_id", "x", "y", (-F.col("top.ord")).alias("region"))


def lifted_cells(landmarks: DataFrame) -> DataFrame:
    """image_id, x, y, lift: the cells of the squares around landmarks, and the largest lift of each."""
    axis = F.sequence(-F.col("grid_radius"), F.col("grid_radius"))
    lift = 1 + F.when(F.col("priority") == "hard", 2.0).otherwise(1.0) * F.col("confidence")
    spots = landmarks.select("image_id", "x", "y", "grid_radius", lift.alias("lift"), F.explode(axis).alias("dx")).select("*", F.explode(axis).alias("dy"))
    return spots.select("image_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "lift").groupBy("image_id", "x", "y").agg(F.max("lift").alias("lift"))


def cell_weight(importance: Column) -> Column:
    """A cell's weight by its importance and its column lift, null outside all squares of landmarks."""
    base = 0.75 + 1.25 * importance
    return F.greatest(base, F.coalesce("lift", base))


def importance_weights(importance: DataFrame, landmarks: DataFrame) -> DataFrame:
    """image_id, x, y, weight: 0.75 + 1.25 * importance, lifted in the squares around landmarks."""
    return importance.join(lifted_cells(landmarks), ["image_id", "x", "y"], "left").select("image_id", "x", "y", cell_weight(F.col("importance")).alias("weight"))


def ranked(candidates: DataFrame, most: int = 5) -> DataFrame:
    """The best candidates of each image: valid ones first, then by score, then by id."""
    nth = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("valid"), F.desc("total"), "candidate_id"))
    return candidates.withColumn("nth", nth).where(F.col("nth") <= most)


def statuses(ranks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """image_id, status by the first candidate; images without a candidate have none that is valid."""
    first = ranks.where("nth = 1").select("image_id", F.when(F.col("valid"), "success").otherwise("best-effort").alias("status"))
    return first if images is None else images.join(first, "image_id", "left").select("image_id", F.coalesce("status", F.lit("no-valid-candidate")).alias("status"))


def scored_styles(measures: DataFrame, max_colors: int) -> DataFrame:
    """measures crossed with the styles: candidate_id, style, total."""
    names = ("source", "reference", "plan", "structure", "feature", "confidence", "isolated", "stripes", "cells", "colors", "canvas")
    of = {n: F.col(n) for n in names}
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("style"), score(of, s, max_colors, v[4]).alias("total")) for s, v in color.STYLES.items())))
    return measures.select("*", each.alias("c")).select("image_id", "valid", F.concat_ws(":", F.col("image_id").cast("string"), "c.style").alias("candidate_id"), "c.style", "c.total")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule (a rule is a column that holds for valid rows; null breaks it)."""
    counts = rows.agg(*(F.sum(F.when(F.coalesce(rule, F.lit(False)), 0).otherwise(1)).alias(name) for name, rule in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.coalesce(name, F.lit(0)).alias("n")) for name in rules))).alias("r")).select("r.*")


def duplicated(rows: DataFrame, key: str) -> DataFrame:
    """The keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
