"""Engine inputs derived from the test tables: images, palette, masks, evaluation records, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", "embedding", at.alias("i"))


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, r, g, b of 8 x 8 images."""
    value = lambda shift: F.element_at("embedding", ((F.col("i") + shift) % (SIDE * SIDE) + 1).cast("int")).cast("double")
    byte = lambda shift: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((value(shift) + 0.5) * 255 + 0.5))).cast("int")
    return _cells(spark, sf_dir).select("image_id", (F.col("i") % SIDE).cast("int").alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), byte(0).alias("r"), byte(21).alias("g"), byte(42).alias("b"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, x, y, v in 0..1."""
    v = F.element_at("embedding", (F.col("i") + 1).cast("int")).cast("double") + 0.5
    return _cells(spark, sf_dir).select("image_id", "label", (F.col("i") % SIDE).cast("int").alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias("v"))


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, color_id, r, g, b of 24 colours."""
    k = F.col("p_partkey")
    part = _table(spark, sf_dir, "part").where(k.between(1, 24))
    channel = lambda m, n: (k * m % 256).cast("int").alias(n)
    return part.select(k.cast("int").alias("ord"), F.concat(F.lit("c"), F.lpad(k.cast("string"), 3, "0")).alias("color_id"), channel(53, "r"), channel(97, "g"), channel(193, "b"))


INTERACTION = """SELECT event_id AS image_id, user_id % 150 AS rater_id,
 CASE user_id % 4 WHEN 0 THEN 'portrait' WHEN 1 THEN 'pet' WHEN 2 THEN 'illustration' ELSE 'object' END AS category,
 CASE WHEN event_type = 'view' THEN 'clean-control' WHEN event_id % 10 = 0 THEN 'extreme' ELSE 'targeted-failure' END AS cohort,
 event_type = 'view' AS initial_ok,
 CASE event_type WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'cancelled' WHEN 'error' THEN 'error' ELSE 'confirmed' END AS outcome,
 CASE WHEN event_type IN ('purchase','signup') THEN event_type = 'purchase' END AS subject_ok,
 CASE WHEN event_type IN ('purchase','signup','click') THEN floor(value*100) END AS duration_ms,
 CASE WHEN event_type IN ('purchase','signup','click') THEN event_id % 9 ELSE 0 END AS stroke_count,
 CASE WHEN user_id % 3 = 0 THEN 'mobile' WHEN user_id % 3 = 1 THEN 'tablet' ELSE 'desktop' END AS device_class,
 CASE WHEN event_id % 2 = 0 THEN 'touch' ELSE 'mouse' END AS input_modality FROM events"""


def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records, one for each image."""
    return spark.sql(INTERACTION.replace("FROM events", "FROM {events}"), events=_table(spark, sf_dir, "events"))


def preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, rater_id, choice, left_variant of confirmed records."""
    i = F.col("image_id")
    choice = F.when(i % 5 == 0, "tie").when(i % 5 == 1, "right").otherwise("left")
    return interaction(spark, sf_dir).where("outcome = 'confirmed'").select(i, "rater_id", choice.alias("choice"), F.when(i % 2 == 0, "before").otherwise("after").alias("left_variant"))


def landmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two eyes for each image."""
    side = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label", side.alias("s"))
    return rows.select(
        F.col("vec_id").alias("image_id"), F.concat(F.lit("eye-"), F.col("s").cast("string")).alias("landmark_id"), F.lit("eye").alias("kind"),
        F.when(F.col("s") == 0, F.col("label") % 4).otherwise(7 - F.col("label") % 4).cast("int").alias("x"), F.lit(3).alias("y"),
        F.when(F.col("vec_id") % 3 == 0, 0.4).otherwise(1.0).alias("confidence"), F.when(F.col("vec_id") % 2 == 0, "hard").otherwise("soft").alias("priority"),
        (F.col("vec_id") % 2).cast("int").alias("grid_radius"), F.lit("eyes").alias("symmetry_group"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for fusion: image_id, evidence_id, confidence, user_confirmed, source_priority."""
    v = F.col("vec_id")
    return _table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), v.alias("evidence_id"), ((v % 10).cast("double") / 10).alias("confidence"), (v % 17 == 0).alias("user_confirmed"), (v % 7).cast("int").alias("source_priority"))


def stroke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, ord, mode, px, py, radius of a stroke log."""
    n = F.length("text")
    return _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.when(F.col("role") == "assistant", "erase").otherwise("add").alias("mode"), ((n % 101) / 100).alias("px"), ((n * 7 % 101) / 100).alias("py"), F.lit(0.2).alias("radius")
    )
