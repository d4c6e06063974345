"""Queries of evidence: whole fusion, protected cells, budgets and visibility of landmark features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import features, fusion, planning, raster
from tessella.plans.registry import ASSIGNED, MASK, PALETTE, PIXEL, e2000_ctes, lab_ctes, query, r4, sql_r4, with_
from tessella.sources import views

# Analyses of images: some 40 of each, from the embeddings. These texts hold in both engines.
ANALYSIS = """SELECT label AS image_id, vec_id AS analysis_id, CASE vec_id % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'landscape' WHEN 2 THEN 'pet' ELSE NULL END AS image_type, CASE WHEN vec_id % 5 = 0 THEN concat('map-', CAST(vec_id AS VARCHAR(12))) END AS importance_key,
 CASE WHEN vec_id % 4 > 0 THEN concat('crop-', CAST(vec_id % 9 AS VARCHAR(12))) END AS crop_key, CASE vec_id % 7 WHEN 0 THEN 'manual' WHEN 1 THEN NULL ELSE 'automatic' END AS crop_source, CASE WHEN vec_id % 3 > 0 THEN vec_id % 10 / 10e0 END AS crop_confidence,
 CASE WHEN vec_id % 2 = 0 THEN vec_id % 8 / 8e0 END AS confidence, CASE WHEN vec_id % 3 = 0 THEN 'seg' WHEN vec_id % 3 = 1 THEN 'face' END AS model, concat('v', CAST(vec_id % 4 AS VARCHAR(12))) AS model_version,
 CASE vec_id % 3 WHEN 0 THEN 'model' ELSE 'source' END AS origin, CASE vec_id % 11 WHEN 0 THEN '  ' WHEN 1 THEN ' cam ' ELSE 'cam' END AS provider, CASE WHEN vec_id % 2 = 0 THEN 'a' END AS version FROM embeddings"""
SUBJECT = """SELECT label AS image_id, concat('rev-', CAST(vec_id AS VARCHAR(12))) AS revision, vec_id % 10 / 10e0 AS confidence, vec_id % 17 = 0 AS user_confirmed, CASE vec_id % 7 WHEN 0 THEN 'manual' WHEN 1 THEN 'ai+manual' WHEN 2 THEN 'ai' WHEN 3 THEN 'alpha' WHEN 4 THEN 'heuristic' WHEN 5 THEN 'fused' ELSE 'legacy' END AS source,
 'model' AS origin, 'seg' AS provider, CAST(NULL AS VARCHAR(9)) AS model, '2' AS version FROM embeddings WHERE label % 5 > 0"""
PIECE = """SELECT label AS image_id, concat('mark-', CAST(vec_id % 3 AS VARCHAR(12))) AS id, concat('k', CAST(vec_id AS VARCHAR(12))) AS key, vec_id % 4 / 4e0 AS confidence, CASE vec_id % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'fused' WHEN 2 THEN 'model' WHEN 3 THEN 'source' ELSE 'heuristic' END AS origin,
 'lm' AS provider, 'mesh' AS model, CAST(vec_id % 2 AS VARCHAR(12)) AS version FROM embeddings WHERE label % 4 > 0"""


def _rank(column: str, table: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


_ENTRY = "origin || ':' || trim(provider) || ':' || coalesce(trim(model), '') || ':' || coalesce(trim(version), '')"


@query(
    f"""WITH a AS MATERIALIZED ({ANALYSIS}), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY user_confirmed DESC, confidence DESC, {_rank('source', fusion.SUBJECT_PRIORITY)} DESC, revision) AS nth FROM ({SUBJECT})) WHERE nth = 1),
p AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, id ORDER BY confidence DESC, {_rank('origin', fusion.ORIGIN_PRIORITY)} DESC, key) AS nth FROM ({PIECE})) WHERE nth = 1),
c AS (SELECT image_id, crop_key FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY crop_source = 'manual' DESC, coalesce(crop_confidence, 0) DESC, crop_key) AS nth FROM a WHERE crop_key IS NOT NULL AND crop_source IS NOT NULL) WHERE nth = 1),
t AS (SELECT image_id, image_type FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_rank('image_type', fusion.TYPE_PRIORITY)} DESC) AS nth FROM a WHERE image_type IS NOT NULL) WHERE nth = 1),
e AS (SELECT image_id, avg(confidence) AS v FROM (SELECT image_id, confidence FROM s UNION ALL SELECT image_id, confidence FROM p) GROUP BY image_id),
v AS (SELECT image_id, string_agg(model || '=' || v, ', ' ORDER BY model) AS versions FROM (SELECT image_id, model, string_agg(DISTINCT model_version, ' + ' ORDER BY model_version) AS v FROM a WHERE model IS NOT NULL GROUP BY ALL) GROUP BY image_id),
w AS (SELECT image_id, string_agg(DISTINCT entry, ' ' ORDER BY entry) AS provenance FROM (SELECT image_id, {_ENTRY} AS entry FROM s UNION ALL SELECT image_id, {_ENTRY} FROM p UNION ALL SELECT image_id, {_ENTRY} FROM a WHERE trim(provider) <> '') GROUP BY image_id)
SELECT image_id, any_value(s.revision) AS subject, any_value(c.crop_key) AS crop, min(importance_key) AS importance, any_value(t.image_type) AS image_type, {sql_r4('coalesce(any_value(e.v), avg(a.confidence))')} AS confidence,
 any_value(i.ids) AS ids, any_value(versions) AS versions, any_value(provenance) AS provenance
FROM a LEFT JOIN s USING (image_id) LEFT JOIN c USING (image_id) LEFT JOIN t USING (image_id) LEFT JOIN e USING (image_id) LEFT JOIN v USING (image_id) LEFT JOIN w USING (image_id)
 LEFT JOIN (SELECT image_id, string_agg(id || '=' || key, ' ' ORDER BY id) AS ids FROM p GROUP BY image_id) i USING (image_id) GROUP BY image_id"""
)
def fuse_analyses(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    view = lambda text: spark.sql(text.replace("FROM embeddings", "FROM {rows}"), rows=rows)
    return fusion.fused(view(ANALYSIS), view(SUBJECT), view(PIECE)).withColumn("confidence", r4(F.col("confidence")))


# Features

_KINDS = ("eye", "mouth", "ear", "body")


def _landmarks(spark, sf_dir):
    """Two landmarks an image, of all measures; in some images both in one cell, some without a radius."""
    rows = views.landmark(spark, sf_dir)
    i = F.col("image_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (i % 4 + 1).cast("int"))
    return rows.withColumns({"kind": kind, "x": F.when(i % 11 == 0, 3).otherwise(F.col("x")).cast("int")})


_MARKS = f"""mark AS MATERIALIZED (SELECT vec_id AS image_id, 'eye-' || s AS landmark_id, CASE vec_id % 4 {' '.join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(_KINDS))} END AS kind, CASE WHEN vec_id % 11 = 0 THEN 3 WHEN s = 0 THEN label % 4 ELSE 7 - label % 4 END AS x, 3 AS y,
 CASE WHEN vec_id % 3 = 0 THEN 0.4e0 ELSE 1e0 END AS confidence, CASE WHEN vec_id % 2 = 0 THEN 'hard' ELSE 'soft' END AS priority, vec_id % 2 AS grid_radius, vec_id % 2 = 0 AND vec_id % 3 > 0 AS hard FROM embeddings, (VALUES (0), (1)) v(s))"""
_ACTIVE = "active AS MATERIALIZED (SELECT image_id, x, y FROM mask WHERE v >= 0.5)"


def _active(spark, sf_dir):
    return views.mask(spark, sf_dir).where("v >= 0.5").select("image_id", "x", "y")


@query(with_(MASK, _MARKS, _ACTIVE) + "SELECT DISTINCT a.image_id, a.x, a.y FROM active a JOIN mark m ON a.image_id = m.image_id AND abs(a.x - m.x) <= m.grid_radius AND abs(a.y - m.y) <= m.grid_radius WHERE m.hard UNION SELECT image_id, x, y FROM active WHERE x = 0 AND y = 0")
def landmark_protection(spark, sf_dir):
    """Cells that clean-up may not change: around hard landmarks, and the corner (as a shape would add)."""
    active = _active(spark, sf_dir)
    return features.protected_cells(_landmarks(spark, sf_dir), active, active.where("x = 0 and y = 0"))


def _pick(k: int) -> str:
    return "CASE kind " + " ".join(f"WHEN '{kind}' THEN {planning.FEATURES[kind][k]}" for kind in _KINDS) + " END"


_BUDGETS = (
    MASK, _MARKS, _ACTIVE,
    f"theory AS (SELECT *, CAST(least({_pick(2)}, greatest(1, CASE WHEN image_id % 5 = 0 THEN floor(pow(8e0 / {_pick(3)}, 2) * {_pick(1)} + 0.5) WHEN grid_radius = 0 THEN 1 ELSE 5 END)) AS INT) AS theory FROM mark)",
    "reach AS (SELECT *, 1 + greatest(0, ceil((sqrt(theory) - 1) / 2)) AS reach FROM theory)",
    "cap AS (SELECT r.image_id, landmark_id, count(a.x) AS capacity FROM reach r LEFT JOIN active a ON a.image_id = r.image_id AND abs(a.x - r.x) <= reach AND abs(a.y - r.y) <= reach GROUP BY ALL)",
    "cells AS (SELECT image_id, count(*) AS n FROM active GROUP BY image_id)",
    f"alloc AS (SELECT m.*, capacity, CASE WHEN kind = 'body' THEN least({_pick(2)}, coalesce(n, 0)) ELSE least(theory, capacity) END AS allocated, hard AND count(*) FILTER (hard) OVER w > 1 AND count(DISTINCT x) FILTER (hard) OVER w < count(*) FILTER (hard) OVER w AS collision FROM theory m JOIN cap USING (image_id, landmark_id) LEFT JOIN cells USING (image_id) WINDOW w AS (PARTITION BY m.image_id))",
    f"told AS (SELECT *, allocated >= {_pick(0)} AND NOT collision AS feasible, least(1, allocated / CAST({_pick(1)} AS DOUBLE)) AS progress, {_pick(4)} * CASE WHEN priority = 'hard' THEN 1.25e0 ELSE 1e0 END * confidence AS weight FROM alloc)",
    "budget AS MATERIALIZED (SELECT *, CASE WHEN NOT feasible THEN 0e0 WHEN hard THEN 0.8e0 + 0.2e0 * progress ELSE progress END AS satisfaction FROM told)",
)


def _budgets(spark, sf_dir):
    marks = _landmarks(spark, sf_dir).withColumn("grid_radius", F.when(F.col("image_id") % 5 != 0, F.col("grid_radius")))
    return features.budgets(marks, _active(spark, sf_dir), 8)


@query(with_(*_BUDGETS) + f"SELECT image_id, landmark_id, CAST(allocated AS BIGINT) AS allocated, capacity, hard, feasible, collision, {sql_r4('satisfaction')} AS satisfaction, {sql_r4('weight')} AS weight FROM budget")
def feature_capacity(spark, sf_dir):
    out = _budgets(spark, sf_dir).drop("kind")
    return out.withColumns({c: r4(F.col(c)) for c in ("satisfaction", "weight")})


@query(
    with_(*_BUDGETS)
    + f"""SELECT image_id, {sql_r4('CASE WHEN sum(weight) > 0 THEN greatest(0, least(1, 1 - sum(weight * (1 - satisfaction)) / sum(weight))) ELSE 1 END')} AS score, count(*) FILTER (hard AND NOT feasible) = 0 AS feasible,
 concat_ws(',', CASE WHEN bool_or(hard AND NOT feasible AND collision) THEN 'canvas-hard-feature-collision' END, CASE WHEN bool_or(hard AND NOT feasible AND NOT collision) THEN 'canvas-hard-feature-underbudget' END) AS reasons FROM budget GROUP BY image_id"""
)
def feature_collisions(spark, sf_dir):
    return features.budget_scores(_budgets(spark, sf_dir)).withColumn("score", r4(F.col("score")))


def _of(k: int, quote: str = "") -> str:
    return "CASE kind " + " ".join(f"WHEN '{kind}' THEN {quote}{features.PROFILES[kind][k]}{quote}" for kind in _KINDS) + " END"


_SEEN = (
    PIXEL, PALETTE, ASSIGNED, _MARKS, lab_ctes("palette", "cl"), lab_ctes("pixel", "pl"),
    "cell AS MATERIALIZED (SELECT image_id, x, y, ord, CASE WHEN (x + y) % 3 > 0 THEN x // 4 + 2 * (y // 4) END AS region FROM assigned WHERE (x * 5 + y * 3 + image_id) % 9 > 0)",
    "around AS MATERIALIZED (SELECT m.image_id, m.landmark_id, m.grid_radius AS r, c.x - m.x AS dx, c.y - m.y AS dy, c.ord, c.region, o.ord AS center, o.region AS center_region FROM mark m JOIN cell o ON o.image_id = m.image_id AND o.x = m.x AND o.y = m.y JOIN cell c ON c.image_id = m.image_id AND abs(c.x - m.x) <= m.grid_radius + 1 AND abs(c.y - m.y) <= m.grid_radius + 1)",
    "side AS MATERIALIZED (SELECT *, abs(dx) <= r AND abs(dy) <= r AS inside, ord = center AS same FROM around)",
    "carrier AS (SELECT image_id, landmark_id, region AS carrier FROM (SELECT *, row_number() OVER (PARTITION BY image_id, landmark_id ORDER BY n DESC, region) AS nth FROM (SELECT image_id, landmark_id, region, count(*) AS n FROM side WHERE NOT inside AND region IS NOT NULL GROUP BY ALL)) WHERE nth = 1)",
    "told AS MATERIALIZED (SELECT s.*, coalesce(carrier, center_region) AS carrier FROM side s LEFT JOIN carrier USING (image_id, landmark_id))",
    "ringed AS (SELECT t.image_id, t.landmark_id, p.l AS l1, p.la AS a1, p.lb AS b1, q.l AS l2, q.la AS a2, q.lb AS b2 FROM told t JOIN cl p ON p.ord = center JOIN cl q ON q.ord = t.ord WHERE NOT inside AND (carrier IS NULL OR region = carrier))",
    e2000_ctes("ringed", "ring_far"),
    "far AS (SELECT image_id, landmark_id, avg(distance) AS far FROM ring_far GROUP BY ALL)",
    "link AS (SELECT a.image_id, a.landmark_id, a.dx, a.dy, abs(a.dx) + abs(a.dy) <= 1 OR bool_or(abs(b.dx) + abs(b.dy) = 1 AND abs(a.dx - b.dx) + abs(a.dy - b.dy) = 1) AS reached FROM told a JOIN told b ON a.image_id = b.image_id AND a.landmark_id = b.landmark_id WHERE a.inside AND a.same AND b.inside AND b.same GROUP BY a.image_id, a.landmark_id, a.dx, a.dy)",
    "joined AS (SELECT image_id, landmark_id, avg(CAST(reached AS INT)) AS connectivity FROM link GROUP BY ALL)",
    "sums AS (SELECT image_id, landmark_id, max(center) AS center, count(*) FILTER (inside) AS cells, count(*) FILTER (inside AND same) AS area, avg(CAST(NOT same AS INT)) FILTER (NOT inside) AS boundary FROM told GROUP BY ALL)",
    "source AS (SELECT m.image_id, m.landmark_id, p.l AS l1, p.la AS a1, p.lb AS b1, c.l AS l2, c.la AS a2, c.lb AS b2 FROM mark m JOIN sums USING (image_id, landmark_id) JOIN pl p ON p.image_id = m.image_id AND p.x = m.x AND p.y = m.y JOIN cl c ON c.ord = center)",
    e2000_ctes("source", "source_far"),
    """measured AS (SELECT m.*, center, coalesce(area, 0) AS area, coalesce(least(1, area / CASE WHEN grid_radius = 0 THEN 1 ELSE greatest(2, ceil(cells * 0.4)) END), 0) AS coverage, coalesce(area / greatest(1, cells), 0) AS purity, coalesce(connectivity, 0) AS connectivity,
 coalesce(least(1, far / 24e0), 0) AS contrast, coalesce(boundary, 0) AS boundary, coalesce(1 / (1 + f.distance / 15), 0) AS "match" FROM mark m LEFT JOIN sums USING (image_id, landmark_id) LEFT JOIN far USING (image_id, landmark_id) LEFT JOIN joined USING (image_id, landmark_id) LEFT JOIN source_far f USING (image_id, landmark_id))""",
    f"""feature AS MATERIALIZED (SELECT *, CASE WHEN center IS NULL THEN 0 WHEN kind = 'body' THEN 1 WHEN kind = 'ear' THEN "match" * (0.75 * boundary + 0.25 * contrast) WHEN kind = 'mouth' THEN "match" * (0.2 * coverage + 0.3 * connectivity + 0.25 * contrast + 0.25 * boundary)
 ELSE "match" * (0.25 * coverage + 0.2 * purity + 0.2 * connectivity + 0.35 * contrast) END AS score,
 CASE WHEN NOT hard THEN '' WHEN center IS NULL THEN 'hard-feature-missing' ELSE concat_ws(',', CASE WHEN coverage < {_of(2)} OR purity < {_of(3)} THEN 'hard-feature-area' END, CASE WHEN boundary < {_of(6)} THEN 'hard-feature-boundary' END, CASE WHEN connectivity < {_of(4)} THEN 'hard-feature-fragmented' END,
 CASE WHEN contrast < {_of(5)} THEN 'hard-feature-low-contrast' END, CASE WHEN kind <> 'body' AND "match" < 0.35 THEN 'hard-feature-source-mismatch' END) END AS reasons, confidence * CASE WHEN priority = 'hard' THEN 1.5e0 ELSE 1e0 END * {_of(1)} AS w FROM measured)""",
)
_MEASURES = ("coverage", "purity", "connectivity", "contrast", "boundary", "match", "score")


def _evaluated(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    assigned = raster.assign_nearest(views.pixel(spark, sf_dir), raster.palette_rows(views.palette(spark, sf_dir)))
    cells = assigned.where((x * 5 + y * 3 + F.col("image_id")) % 9 > 0).withColumn("region", F.when((x + y) % 3 > 0, F.floor(x / 4) + 2 * F.floor(y / 4)))
    return features.evaluated(_landmarks(spark, sf_dir), cells, views.pixel(spark, sf_dir), views.palette(spark, sf_dir))


@query(with_(*_SEEN) + "SELECT image_id, landmark_id, area, " + ", ".join(f"{sql_r4(chr(34) + c + chr(34))} AS {chr(34)}{c}{chr(34)}" for c in _MEASURES) + ", reasons FROM feature")
def feature_measures(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("image_id", "landmark_id", "area", *(r4(F.col(c)).alias(c) for c in _MEASURES), "reasons")


_TOLD = ("score", "confidence", "coverage", "purity", "connectivity", "contrast")


@query(
    with_(
        *_SEEN,
        "mean_ AS (SELECT image_id, " + ", ".join(f"sum({c} * w) / sum(w) AS {c}" for c in _TOLD) + ", count(DISTINCT x) / 2e0 * (min(area) / CAST(greatest(1, max(area)) AS DOUBLE)) AS symmetry, count(*) FILTER (hard) > 1 AND count(DISTINCT x) FILTER (hard) < count(*) FILTER (hard) AS collides FROM feature GROUP BY image_id)",
        "why AS (SELECT image_id, string_agg(DISTINCT r, ',' ORDER BY r) AS reasons FROM (SELECT image_id, unnest(string_split(reasons, ',')) AS r FROM feature UNION ALL SELECT image_id, 'hard-feature-collision' FROM mean_ WHERE collides) WHERE r <> '' GROUP BY image_id)",
    )
    + f"SELECT image_id, {sql_r4('greatest(0, least(1, 0.85 * score + 0.15 * symmetry))')} AS score, " + ", ".join(f"{sql_r4(c)} AS {c}" for c in _TOLD[1:]) + ", reasons IS NULL AS valid, coalesce(reasons, '') AS reasons FROM mean_ LEFT JOIN why USING (image_id)"
)
def feature_visibility(spark, sf_dir):
    out = features.visibility(_evaluated(spark, sf_dir))
    return out.withColumns({c: r4(F.col(c)) for c in _TOLD})
