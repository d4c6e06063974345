"""Confirmed corrections of masks: revisions that name their base and the strokes made on it, and chains of such revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import canonical, identities

#: What a revision starts with, and the origin that a correction adds.
PREFIX = "mask-editor:v1:"
MANUAL = {"origin": "manual", "provider": "mask-editor", "model": None, "version": "1"}
MODES, MOST_STROKES = ("add", "erase"), 512


def stroke_log(strokes: Column) -> Column:
    """JSON of an array of strokes (id, mode, radius, points of x and y); blanks around ids and the encoding of numbers don't count."""
    pair = lambda p: F.concat(F.lit("["), canonical.number(p.x.cast("double")), F.lit(","), canonical.number(p.y.cast("double")), F.lit("]"))
    listed = lambda v: F.concat(F.lit("["), F.array_join(v, ","), F.lit("]"))
    one = lambda s: listed(F.array(canonical.text(F.trim(s.id)), canonical.text(s.mode), canonical.number(s.radius.cast("double")), listed(F.transform(s.points, pair))))
    return listed(F.transform(strokes, one))


def revision(base_identity: Column, strokes: Column) -> Column:
    return F.concat(F.lit(PREFIX), identities.text_fingerprint(F.concat(base_identity, F.lit("\0"), stroke_log(strokes))))


def log_errors(strokes: Column) -> Column:
    """What is wrong with a log of strokes, as sorted names."""
    share = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (v >= 0) & (v <= 1)
    bad = lambda test: F.exists(strokes, lambda s: ~F.coalesce(test(s), F.lit(False)))
    ids = F.transform(strokes, lambda s: F.trim(s.id))
    tests = {
        "blank-id": bad(lambda s: F.trim(s.id) != ""),
        "mode": bad(lambda s: s.mode.isin(*MODES)),
        "no-points": bad(lambda s: F.size(s.points) > 0),
        "point": bad(lambda s: F.forall(s.points, lambda p: share(p.x) & share(p.y))),
        "radius": bad(lambda s: share(s.radius) & (s.radius > 0)),
        "repeated-id": F.size(F.array_distinct(ids)) < F.size(ids),
        "too-many": F.size(strokes) > MOST_STROKES,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), name) for name, t in tests.items())))


def _provenance(entries: Column) -> Column:
    """Entries (origin, provider, model, version) trimmed, each once and in order, with the correction's own."""
    clean = lambda v: F.when(F.trim(v) != "", F.trim(v))
    own = F.struct(*(F.lit(v).cast("string").alias(k) for k, v in MANUAL.items()))
    trimmed = F.transform(F.coalesce(entries, F.array().cast("array<struct<origin: string, provider: string, model: string, version: string>>")), lambda e: F.struct(*(clean(e[k]).alias(k) for k in MANUAL)))
    return F.array_sort(F.array_distinct(F.concat(F.filter(trimmed, lambda e: e.origin.isNotNull()), F.array(own))))


def confirmed(evidence: DataFrame, sessions: DataFrame) -> DataFrame:
    """session, base_revision, revision, source, user_confirmed, provenance and errors of each session.

    evidence: revision, base_identity (revision, size and fingerprint of its mask, as one text), source and provenance (array of origin,
    provider, model, version). sessions: session, base_revision, and strokes, those up to the cursor. With errors there is no revision;
    a base that no evidence has is the error base-revision.
    """
    base = evidence.select(F.col("revision").alias("base_revision"), "base_identity", "source", "provenance", F.lit(True).alias("known"))
    both = sessions.join(base, "base_revision", "left")
    errors = F.concat(F.when(F.col("known").isNull(), F.array(F.lit("base-revision"))).otherwise(F.array().cast("array<string>")), log_errors(F.col("strokes")))
    told = both.withColumn("errors", errors)
    sound = F.size("errors") == 0
    by_model = F.col("source").isin("ai", "ai+manual") | F.exists(F.coalesce("provenance", F.array().cast("array<struct<origin: string, provider: string, model: string, version: string>>")), lambda e: e.origin == "model")
    return told.select(
        "session", "base_revision", F.when(sound, revision(F.col("base_identity"), F.col("strokes"))).alias("revision"), F.when(sound, F.when(F.coalesce(by_model, F.lit(False)), "ai+manual").otherwise("manual")).alias("source"),
        sound.alias("user_confirmed"), F.when(sound, _provenance(F.col("provenance"))).alias("provenance"), "errors",
    )


def broken_links(revisions: DataFrame, roots: DataFrame) -> DataFrame:
    """The revisions (revision, base_revision) whose base is neither a revision nor one of the roots (revision)."""
    known = revisions.select(F.col("revision").alias("base_revision")).union(roots.select(F.col("revision").alias("base_revision"))).distinct()
    return revisions.join(known, "base_revision", "left_anti").select("revision", "base_revision")
