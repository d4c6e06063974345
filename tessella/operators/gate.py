"""Evaluation analytics: counts, rates, percentiles, the gate report, preferences and ordering."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import rate, wilson


@dataclass(frozen=True)
class Thresholds:
    """What a gate needs to pass. Fixed defaults."""

    total: int = 40
    mobile: int = 8
    initial_failures: int = 24
    categories: dict[str, int] = field(default_factory=lambda: {"portrait": 12, "pet": 12, "illustration": 8, "object": 8})
    cohorts: dict[str, int] = field(default_factory=lambda: {"targeted-failure": 32, "clean-control": 4, "extreme": 4})
    mobile_categories: dict[str, int] = field(default_factory=lambda: {"portrait": 2, "pet": 2, "illustration": 2, "object": 2})
    within_30s: float = 0.8
    p50_ms: float = 15_000
    p90_ms: float = 30_000
    median_strokes: float = 6
    after_preference: float = 0.75
    control_preservation: float = 0.9
    ratings: int = 1


def failed() -> Column:
    return ~F.col("initial_ok")


def resolved() -> Column:
    return failed() & (F.col("outcome") == "confirmed") & F.coalesce(F.col("subject_ok"), F.lit(False))


def touched() -> Column:
    return (F.col("device_class") == "mobile") & F.col("input_modality").isin("touch", "pen")


def preferred(preferences: DataFrame) -> DataFrame:
    """preferences with resolved: before, after or tie."""
    other = F.when(F.col("left_variant") == "before", "after").otherwise("before")
    return preferences.withColumn("resolved", F.when(F.col("choice") == "tie", "tie").when(F.col("choice") == "left", F.col("left_variant")).otherwise(other))


def counts_by(records: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """key, n: zero where no record has the key."""
    wanted = records.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    found = records.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    return wanted.join(found, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def measures(by: list[str], records: DataFrame) -> DataFrame:
    """One row (for each group): counts, rates and percentiles of the records."""
    when = lambda c: F.sum(F.when(c, 1).otherwise(0))
    quick = resolved() & (F.col("duration_ms") <= 30_000)
    control = F.col("cohort") == "clean-control"
    kept = control & F.col("initial_ok") & (F.col("outcome") == "accepted")
    took, strokes = F.when(resolved(), F.col("duration_ms").cast("double")), F.when(resolved(), F.col("stroke_count").cast("double"))
    out = records.groupBy(*by).agg(
        F.count("*").alias("interactions"), when(failed()).alias("failures"), when(resolved()).alias("resolved"), when(quick).alias("quick"), when(control).alias("controls"), when(kept).alias("preserved"),
        when(touched()).alias("mobile"), *(when(F.col("outcome") == o).alias(o) for o in ("accepted", "confirmed", "cancelled", "error")),
        F.percentile(took, 0.5).alias("p50_ms"), F.expr("percentile_disc(0.9) within group (order by case when not initial_ok and outcome = 'confirmed' and subject_ok then cast(duration_ms as double) end)").alias("p90_ms"),
        F.percentile(strokes, 0.5).alias("median_strokes"),
    )
    return out.withColumn("within_30s", rate(F.col("quick"), F.col("failures"))).withColumn("control_preservation", rate(F.col("preserved"), F.col("controls")))


def gate_summary(records: DataFrame, preferences: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """The report: measures, confidence limits, each criterion and whether all pass."""
    sums = lambda column, keys, only: [F.sum(F.when((F.col(column) == k) & only, 1).otherwise(0)) >= n for k, n in keys.items()]
    every = lambda parts: F.coalesce(reduce(and_, parts), F.lit(False))
    covers = records.agg(
        every(sums("category", limits.categories, F.lit(True))).alias("c1"), every(sums("cohort", limits.cohorts, F.lit(True))).alias("c2"), every(sums("category", limits.mobile_categories, touched())).alias("c3"),
    )
    rated = preferences.groupBy("image_id").agg(F.count("*").alias("n"))
    confirmed = records.where("outcome = 'confirmed'").select("image_id").distinct().join(rated, "image_id", "left")
    rating = confirmed.agg(F.coalesce(F.min(F.coalesce("n", F.lit(0)) >= limits.ratings), F.lit(True)).alias("preference_coverage"))
    after = preferred(preferences).agg(F.count("*").alias("preferences"), F.sum(F.when(F.col("resolved") == "after", 1).otherwise(0)).alias("after"))
    one = measures([], records).join(F.broadcast(covers)).join(F.broadcast(rating)).join(F.broadcast(after))  # one row each
    at_most = lambda c, m: F.coalesce(F.col(c) <= m, F.lit(False))
    at_least = lambda c, m: F.coalesce(c >= m, F.lit(False))
    liked = rate(F.col("after"), F.col("preferences"))
    criteria = {
        "sample_coverage": (F.col("interactions") >= limits.total) & F.col("c1") & F.col("c2"),
        "mobile_coverage": (F.col("mobile") >= limits.mobile) & F.col("c3"),
        "failure_coverage": F.col("failures") >= limits.initial_failures,
        "preferences_cover": F.col("preference_coverage"),
        "quick_enough": at_least(F.col("within_30s"), limits.within_30s),
        "p50_passes": at_most("p50_ms", limits.p50_ms),
        "p90_passes": at_most("p90_ms", limits.p90_ms),
        "strokes_pass": at_most("median_strokes", limits.median_strokes),
        "after_passes": at_least(liked, limits.after_preference),
        "controls_pass": at_least(F.col("control_preservation"), limits.control_preservation),
    }
    passed = F.lit(True)
    for c in criteria.values():
        passed = passed & c
    low = wilson(F.col("quick"), F.col("failures"))
    return one.select("interactions", "failures", "resolved", "quick", "controls", "preserved", "mobile", "preferences", "p50_ms", "p90_ms", "median_strokes", low["lower"].alias("quick_low"), low["upper"].alias("quick_high"), *(v.alias(k) for k, v in criteria.items()), passed.alias("passed"))


def sample_order(samples: DataFrame, seed: str, key: str = "image_id") -> DataFrame:
    """key and position, from 1, in the order of a seeded hash.

    Rows are numbered within 4,096 even ranges of the hash and moved by the rows of the ranges before.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    hashed = samples.select(key, digest.alias("digest"), F.coalesce(F.substring(digest, 1, 3), F.lit("")).alias("range"))
    counts = hashed.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("digest", key))
    return hashed.select(key, "range", nth.alias("nth")).join(F.broadcast(before), "range").select(key, (F.col("before") + F.col("nth")).alias("position"))  # at most 4,097 ranges


def blind_left(seed: Column) -> Column:
    """Which variant stands left, by the parity of the seed hash's first byte."""
    return F.when(F.conv(F.substring(F.sha2(seed, 256), 1, 2), 16, 10).cast("int") % 2 == 0, "before").otherwise("after")


def manifest_coverage(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """missing and unknown image counts, and whether records and manifest agree."""
    missing = manifest.join(records, "image_id", "left_anti").agg(F.count("*").alias("missing"))
    unknown = records.join(manifest, "image_id", "left_anti").agg(F.count("*").alias("unknown"))
    return missing.join(F.broadcast(unknown)).select("missing", "unknown", ((F.col("missing") == 0) & (F.col("unknown") == 0)).alias("covered"))
