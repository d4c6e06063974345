"""Evaluation records: rules as columns, records built from sound attempts, and how records, manifest and preferences agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The allowed words.
VERSION = "mask-gate-v2"
CATEGORIES, COHORTS = ("portrait", "pet", "illustration", "object"), ("targeted-failure", "clean-control", "extreme")
PERMISSIONS, MODALITIES, CHOICES = ("owned", "licensed", "public-domain", "research-consent"), ("touch", "pen", "mouse"), ("left", "right", "tie")
SAMPLE_ID = "^[a-zA-Z0-9][a-zA-Z0-9_-]{0,79}$"
#: A manifest has at most this many samples.
MOST_SAMPLES = 200


# What a value must be. Each gives a column that is true or false, never null.


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_text(c: str) -> Column:
    return _sure(F.trim(c) != "")


def is_finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return _sure(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def is_unit(c: str) -> Column:
    return is_finite(c) & _sure(F.col(c).between(0, 1))


def is_integer(c: str, least: int = 0) -> Column:
    return is_finite(c) & _sure((F.col(c) == F.floor(c)) & (F.col(c) >= least))


def is_one_of(c: str, words: tuple[str, ...]) -> Column:
    return _sure(F.col(c).isin(*words))


def are_unique_texts(c: str) -> Column:
    """A comma-joined list of one or more different texts."""
    parts = F.split(c, ",")
    return _sure((F.col(c) != "") & F.forall(parts, lambda p: F.trim(p) != "") & (F.size(F.array_distinct(parts)) == F.size(parts)))


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order, comma-joined."""
    return F.concat_ws(",", *(F.when(~_sure(rule), name) for name, rule in rules.items()))


# Attempts


def corrected() -> Column:
    """Whether an attempt has a correction: not if accepted, and on an error only once editing had started."""
    return F.col("outcome").isin("confirmed", "cancelled") | ((F.col("outcome") == "error") & F.col("started_at").isNotNull())


def interaction_rules() -> dict[str, Column]:
    outcome, edited = F.col("outcome"), corrected()
    confirmation = [F.col("confirmed_revision").isNotNull(), F.col("subject_ok").isNotNull()]
    return {
        "attempt_id": F.col("attempt_id").isNotNull(),
        "protocol_version": F.col("protocol_version") == VERSION,
        "dataset_id": is_text("dataset_id"),
        "failure_tags": are_unique_texts("tags"),
        "sample_order": is_integer("sample_order", 1),
        "confidence": is_unit("confidence"),
        "snapshot": is_integer("width", 1) & is_integer("height", 1),
        "device": is_one_of("modality", MODALITIES),
        "rating": (outcome == "accepted") == F.col("initial_ok"),
        "base_revision": ~edited | (F.col("base_revision") == F.col("source_revision")),
        "duration": ~edited | (is_finite("started_at") & is_finite("ended_at") & _sure(F.col("ended_at") >= F.col("started_at"))),
        "cursor": ~edited | (is_integer("cursor_at") & (F.col("cursor_at") <= F.col("strokes"))),
        "confirmation_missing": (outcome != "confirmed") | (confirmation[0] & confirmation[1]),
        "confirmation_only": (outcome == "confirmed") | ~(confirmation[0] | confirmation[1]),
        "error_details": (outcome == "error") == F.col("error_code").isNotNull(),
    }


def interactions(attempts: DataFrame) -> DataFrame:
    """attempt_id, image_id, outcome, duration_ms, stroke, add and erase counts (of the log up to the cursor) of sound attempts."""
    sound = attempts.where(broken(interaction_rules()) == "")
    active = F.least("cursor_at", "strokes")
    added = F.least("adds", active)
    only = lambda c: F.when(corrected(), c).otherwise(0)
    return sound.select(
        "attempt_id", "image_id", "outcome", F.when(corrected(), F.col("ended_at") - F.col("started_at")).alias("duration_ms"), only(active).alias("stroke_count"), only(added).alias("add_count"), only(active - added).alias("erase_count"), "confirmed_revision"
    )


def preferences(attempts: DataFrame) -> DataFrame:
    """preference_id (image and rater), attempt_id and preference of sound, confirmed attempts with a choice."""
    rated = attempts.where((F.col("outcome") == "confirmed") & (broken(interaction_rules()) == "") & is_one_of("choice", CHOICES))
    other = F.when(F.col("left_variant") == "before", "after").otherwise("before")
    choice = F.when(F.col("choice") == "tie", "tie").when(F.col("choice") == "left", F.col("left_variant")).otherwise(other)
    return rated.select(F.concat("image_id", F.lit(":"), "rater_id").alias("preference_id"), "attempt_id", choice.alias("preference"))


# Manifests


def with_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """rows with n_alike: how many of them have the row's key. Counts are partial before the shuffle."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n_alike"))
    return rows.join(counts, key)


def sample_rules() -> dict[str, Column]:
    return {
        "image_id": F.col("image_id").rlike(SAMPLE_ID),
        "category": is_one_of("category", CATEGORIES),
        "cohort": is_one_of("cohort", COHORTS),
        "failure_tags": are_unique_texts("tags"),
        "subject_count": is_integer("subject_count", 1),
        "permission": is_one_of("permission", PERMISSIONS),
        "reference": is_text("reference"),
        "duplicate": F.col("n_alike") == 1,
    }


def same_texts(a: str, b: str) -> Column:
    """Whether two comma-joined lists hold the same texts, each as often."""
    return F.array_sort(F.split(a, ",")) == F.array_sort(F.split(b, ","))


def against_manifest(attempts: DataFrame, samples: DataFrame) -> DataFrame:
    """verdict (absent, metadata, agrees) and number of attempts, and how many samples are unrated."""
    own = samples.select("image_id", F.col("category").alias("s_category"), F.col("cohort").alias("s_cohort"), F.col("tags").alias("s_tags"))
    both = attempts.join(own, "image_id", "left")
    same = (F.col("category") == F.col("s_category")) & (F.col("cohort") == F.col("s_cohort")) & same_texts("tags", "s_tags")
    verdicts = both.groupBy(F.when(F.col("s_category").isNull(), "absent").when(same, "agrees").otherwise("metadata").alias("verdict")).agg(F.count("*").alias("attempts"))
    unrated = samples.join(attempts.select("image_id").distinct(), "image_id", "left_anti").agg(F.lit("unrated").alias("verdict"), F.count("*").alias("attempts"))
    return verdicts.union(unrated)


def against_interactions(preferences: DataFrame, attempts: DataFrame) -> DataFrame:
    """attempt_id and verdict of each preference: duplicate, unconfirmed, identity, snapshot or agrees."""
    own = attempts.select(F.col("attempt_id").alias("of_attempt"), "outcome", F.col("dataset_id").alias("i_dataset"), F.col("width").alias("i_width"))
    both = with_duplicates(preferences, "preference_id").join(own, "of_attempt", "left")
    verdict = (
        F.when(F.col("n_alike") > 1, "duplicate").when(~_sure(F.col("outcome") == "confirmed"), "unconfirmed").when(F.col("dataset_id") != F.col("i_dataset"), "identity").when(F.col("width") != F.col("i_width"), "snapshot").otherwise("agrees")
    )
    return both.select("attempt_id", verdict.alias("verdict"))


# Requests to the engine

#: Limits of a request.
MOST_SIDE, MOST_PIXELS, MOST_CANVAS, MOST_CELLS, MOST_PALETTE, MOST_SELECTED, MOST_CANVASES, MOST_REFINEMENTS = 2048, 4_000_000, 96, 9216, 128, 48, 12, 32
STYLES = ("faithful", "cute", "simple", "high-contrast", "soft")
OCCUPANCY = ("auto", "full-frame", "subject-shape")


def request_rules() -> dict[str, Column]:
    """Rules of a generation request: width, height, canvas_w, canvas_h, colors, max_colors, canvases, refinements, style, occupancy,
    background, confidence, crop_w, crop_h, mask_w, mask_h, mask_top (the mask's largest value, null without a mask), timeout_ms."""
    upto = lambda c, most, least=1: is_integer(c, least) & _sure(F.col(c) <= most)
    masked = F.col("mask_top").isNotNull()
    return {
        "image": upto("width", MOST_SIDE) & upto("height", MOST_SIDE) & _sure(F.col("width") * F.col("height") <= MOST_PIXELS),
        "canvas": upto("canvas_w", MOST_CANVAS) & upto("canvas_h", MOST_CANVAS) & _sure(F.col("canvas_w") * F.col("canvas_h") <= MOST_CELLS),
        "palette": upto("colors", MOST_PALETTE),
        "max_colors": upto("max_colors", MOST_SELECTED),
        "canvases": upto("canvases", MOST_CANVASES),
        "refinements": upto("refinements", MOST_REFINEMENTS, 0),
        "style": is_one_of("style", STYLES),
        "occupancy": is_one_of("occupancy", OCCUPANCY),
        "background": upto("background", 255, 0),
        "confidence": is_unit("confidence"),
        "crop": is_finite("crop_w") & is_finite("crop_h") & _sure((F.col("crop_w") > 0) & (F.col("crop_h") > 0)),
        "mask": ~masked | (_sure((F.col("mask_w") == F.col("width")) & (F.col("mask_h") == F.col("height"))) & is_unit("mask_top")),
        "subject": (F.col("occupancy") != "subject-shape") | (masked & _sure((F.col("mask_top") >= 0.5) & (F.col("confidence") >= 0.5))),
        "timeout": is_finite("timeout_ms") & _sure(F.col("timeout_ms") > 0),
    }
