"""Fusing evidence of several sources: the best of each kind, whatever their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Priorities of sources, origins and image types.
SUBJECT_PRIORITY = {"manual": 6, "ai+manual": 5, "ai": 4, "alpha": 3, "heuristic": 2, "fused": 1, "legacy": 0}
ORIGIN_PRIORITY = {"manual": 5, "fused": 4, "model": 3, "source": 2, "heuristic": 1}
TYPE_PRIORITY = {"portrait": 5, "pet": 4, "illustration": 3, "landscape": 2, "general": 1}


def _first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__nth = 1").drop("__nth")


def subject(evidence: DataFrame) -> DataFrame:
    """The subject evidence of each image: confirmed by a user, then confidence, then source; ties to the smaller id."""
    return _first(evidence, ["image_id"], [F.desc("user_confirmed"), F.desc("confidence"), F.desc("source_priority"), "evidence_id"])


def best_by_id(evidence: DataFrame, by: list[str]) -> DataFrame:
    """For each id the evidence of the largest confidence, then priority."""
    return _first(evidence, by, [F.desc("confidence"), F.desc("source_priority"), "evidence_id"])


def crop(crops: DataFrame) -> DataFrame:
    """Manual before automatic, then confidence, then the smaller key."""
    return _first(crops, ["image_id"], [F.desc(F.col("kind") == "manual"), F.desc("confidence"), "evidence_id"])


def confidence(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("image_id").agg(F.avg("confidence").alias("confidence"))


def model_versions(used: DataFrame) -> DataFrame:
    """image_id, name, versions: distinct versions in order, joined by ' + '."""
    return used.groupBy("image_id", "name").agg(F.array_join(F.array_sort(F.collect_set("version")), " + ").alias("versions"))


# Whole analyses. Evidence tables are long: one row for each piece, with the image and the analysis that it comes from.


def priority(column: str, table: dict[str, int]) -> Column:
    """The priority of a word; unknown ones and null have none (0)."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col(column)), F.lit(0))


def ranked_subject(subjects: DataFrame) -> DataFrame:
    """The subject of each image: confirmed by a user, then confidence, then source; ties to the smaller revision."""
    return _first(subjects, ["image_id"], [F.desc("user_confirmed"), F.desc("confidence"), priority("source", SUBJECT_PRIORITY).desc(), "revision"])


def merged(evidence: DataFrame) -> DataFrame:
    """For each image and id the evidence of the largest confidence, then origin, ties to the smaller key."""
    return _first(evidence, ["image_id", "id"], [F.desc("confidence"), priority("origin", ORIGIN_PRIORITY).desc(), "key"])


def provenance(*tables: DataFrame) -> DataFrame:
    """image_id, provenance: origin:provider:model:version of all tables, trimmed, distinct, in order; entries without a provider are left out."""
    part = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rows = reduce(DataFrame.unionByName, (t.select("image_id", "origin", "provider", "model", "version") for t in tables))
    entries = rows.select("image_id", F.concat_ws(":", "origin", part("provider"), part("model"), part("version")).alias("entry"), part("provider").alias("own")).where("origin is not null and own <> ''")
    return entries.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("entry")), " ").alias("provenance"))


def fused(analyses: DataFrame, subjects: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each image, whatever the order of its analyses: subject, ids, crop, importance, type, confidence, versions, provenance.

    analyses: image_id, analysis_id, image_type, importance_key, crop_key, crop_source, crop_confidence, confidence, model, model_version, origin, provider, version.
    subjects: image_id, revision, confidence, source, user_confirmed and provenance columns. evidence: image_id, id, key, confidence and provenance columns.
    """
    subject_, best = ranked_subject(subjects), merged(evidence)
    crops = analyses.where("crop_key is not null and crop_source in ('manual', 'automatic')")
    chosen = _first(crops, ["image_id"], [F.desc(F.col("crop_source") == "manual"), F.coalesce("crop_confidence", F.lit(0.0)).desc(), "crop_key"])
    own = analyses.groupBy("image_id").agg(F.min("importance_key").alias("importance"), F.max(F.when(F.col("image_type").isNotNull(), F.struct(priority("image_type", TYPE_PRIORITY).alias("p"), "image_type"))).alias("t"), F.avg("confidence").alias("analysis_confidence"))
    scores = subject_.select("image_id", "confidence").unionByName(best.select("image_id", "confidence")).groupBy("image_id").agg(F.avg("confidence").alias("evidence_confidence"))
    versions = analyses.where("model is not null").groupBy("image_id", "model").agg(F.array_join(F.array_sort(F.collect_set("model_version")), " + ").alias("v"))
    versions = versions.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "model", "v"))), ", ").alias("versions"))
    ids = best.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "id", "key"))), " ").alias("ids"))
    out = own.join(subject_.select("image_id", F.col("revision").alias("subject")), "image_id", "left").join(chosen.select("image_id", F.col("crop_key").alias("crop")), "image_id", "left")
    for table in (scores, versions, ids, provenance(subjects.join(subject_.select("image_id", "revision"), ["image_id", "revision"], "left_semi"), best, analyses)):
        out = out.join(table, "image_id", "left")
    confidence_ = F.coalesce("evidence_confidence", "analysis_confidence")
    return out.select("image_id", "subject", "crop", "importance", F.col("t.image_type").alias("image_type"), confidence_.alias("confidence"), "ids", "versions", "provenance")
