"""Queries of shapes: models of masks, their rasters on a canvas of 6 x 6 cells, energies and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import shapes
from tessella.plans.registry import MASK, query, r4, sql_r4
from tessella.plans.smoothing import recursive
from tessella.sources import views

SIDE = 6


def _variants(spark, sf_dir, sweeps: int):
    images = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"))
    whole = {"cx": 0.0, "cy": 0.0, "cw": 8.0, "ch": 8.0, "width": SIDE, "height": SIDE, "sweeps": sweeps}
    return shapes.keyed(images.withColumns({k: F.lit(v) for k, v in whole.items()}))


def _made(spark, sf_dir, sweeps: int):
    return shapes.rasterised(views.mask(spark, sf_dir), _variants(spark, sf_dir, sweeps))


_SIZE = f"{8 / SIDE}e0"
_RASTER = (
    MASK,
    "seen AS (SELECT image_id FROM mask GROUP BY image_id HAVING max(v) >= 0.5)",
    f"tile AS (SELECT x, y, px, py, (least((x + 1) * {_SIZE}, px + 1) - greatest(x * {_SIZE}, px)) * (least((y + 1) * {_SIZE}, py + 1) - greatest(y * {_SIZE}, py)) / ({_SIZE} * {_SIZE}) AS share FROM range({SIDE}) a(x), range({SIDE}) b(y), range(8) c(px), range(8) d(py) WHERE px < (x + 1) * {_SIZE} AND px + 1 > x * {_SIZE} AND py < (y + 1) * {_SIZE} AND py + 1 > y * {_SIZE})",
    "cover AS MATERIALIZED (SELECT m.image_id, t.x, t.y, CAST(sum(m.v * share) AS FLOAT) AS coverage FROM mask m JOIN tile t ON m.x = px AND m.y = py JOIN seen USING (image_id) GROUP BY ALL)",
    "field AS MATERIALIZED (SELECT m.image_id, m.x, m.y, CAST(CASE WHEN m.v >= 0.5 THEN 1 ELSE -1 END * sqrt(coalesce(min((m.x - o.x) * (m.x - o.x) + (m.y - o.y) * (m.y - o.y)), 129)) AS FLOAT) AS d FROM mask m LEFT JOIN mask o ON m.image_id = o.image_id AND (m.v >= 0.5) <> (o.v >= 0.5) GROUP BY m.image_id, m.x, m.y, m.v)",
    f"spot AS (SELECT x, y, greatest(0e0, least(7e0, (x + 0.5) * {_SIZE} - 0.5)) AS sx, greatest(0e0, least(7e0, (y + 0.5) * {_SIZE} - 0.5)) AS sy FROM range({SIDE}) a(x), range({SIDE}) b(y))",
    "corner AS (SELECT s.x, s.y, least(7, floor(sx) + i) AS px, least(7, floor(sy) + j) AS py, (CASE i WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) * (CASE j WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) AS w FROM spot s, range(2) k(i), range(2) l(j))",
    f"away AS MATERIALIZED (SELECT f.image_id, c.x, c.y, CAST(sum(CAST(f.d AS DOUBLE) * w) / {_SIZE} AS FLOAT) AS distance FROM field f JOIN corner c ON f.x = px AND f.y = py GROUP BY ALL)",
    "cells AS MATERIALIZED (SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, coverage, distance, coverage >= 0.5 OR (max(coverage) OVER i < 0.5 AND coverage > 0 AND row_number() OVER (PARTITION BY image_id ORDER BY coverage DESC, y, x) = 1) AS active FROM cover JOIN away USING (image_id, x, y) WINDOW i AS (PARTITION BY image_id))",
)
_NEAR = "near AS MATERIALIZED (SELECT *, coalesce(lag(active) OVER r, false)::INT + coalesce(lead(active) OVER r, false)::INT + coalesce(lag(active) OVER c, false)::INT + coalesce(lead(active) OVER c, false)::INT AS n FROM cells WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"
_FLAT = "CAST(distance AS DOUBLE)"
_TERMS = f"""abs(active::INT - CAST(coverage AS DOUBLE)) + {shapes.WRONG} * greatest(0e0, least({shapes.FAR}, CASE WHEN active THEN -{_FLAT} ELSE {_FLAT} END))
 + CASE WHEN active THEN CASE WHEN n < 4 THEN {shapes.BOUNDARY} * least({shapes.FAR}, abs({_FLAT})) ELSE 0 END + CASE n WHEN 0 THEN {shapes.LONELY} WHEN 1 THEN {shapes.SINGLE} ELSE 0 END ELSE 0 END"""


def _components(source: str, name: str, on: str, diagonal: bool) -> tuple[str, str]:
    """Regions named by their smallest cell (of rows of 16)."""
    near = "greatest(abs(g.x - r.x), abs(g.y - r.y)) = 1" if diagonal else "abs(g.x - r.x) + abs(g.y - r.y) = 1"
    return (
        f"{name}_reach AS (SELECT image_id, x, y, y * 16 + x AS root FROM {source} WHERE {on} UNION SELECT g.image_id, g.x, g.y, r.root FROM {name}_reach r JOIN {source} g ON g.image_id = r.image_id AND {near} WHERE {on})",
        f"{name} AS MATERIALIZED (SELECT image_id, x, y, min(root) AS part FROM {name}_reach GROUP BY ALL)",
    )


@query("WITH " + ",\n".join(_RASTER) + f"\nSELECT image_id, x, y, {sql_r4('CAST(coverage AS DOUBLE)')} AS coverage, {sql_r4(_FLAT)} AS distance, active FROM cells")
def shape_rasters(spark, sf_dir):
    """Coverage, projected distance and cells of a mask on a canvas, before the search."""
    cells = shapes.variant_cells(_made(spark, sf_dir, 0))
    return cells.select("image_id", "x", "y", *(r4(F.col(c).cast("double")).alias(c) for c in ("coverage", "distance")), "active")


@query(recursive(*_RASTER, _NEAR, *_components("cells", "comp", "active", False)) + f"""SELECT image_id, {sql_r4('energy')} AS energy_before, coalesce(parts, 0)::INTEGER AS components, true AS falls FROM (SELECT image_id, sum({_TERMS}) AS energy FROM near GROUP BY image_id)
 LEFT JOIN (SELECT image_id, count(DISTINCT part) AS parts FROM comp GROUP BY image_id) USING (image_id)""")  # fmt: skip
def shape_energies(spark, sf_dir):
    """The energy before the search, and that two sweeps don't raise it."""
    out = _made(spark, sf_dir, 2)
    return out.select("image_id", r4(F.col("energy_before")).alias("energy_before"), F.col("reference_components").alias("components"), (F.col("energy_after") <= F.col("energy_before") + 1e-9).alias("falls"))


_BANDS = (
    "edge AS (SELECT *, active AND n < 4 AS edge FROM near)",
    "wide AS MATERIALIZED (SELECT a.image_id, a.x, a.y, bool_or(o.edge) AS band FROM edge a JOIN edge o ON a.image_id = o.image_id AND abs(a.x - o.x) <= 1 AND abs(a.y - o.y) <= 1 GROUP BY ALL)",
    f"""score AS (SELECT image_id, CASE WHEN count(*) FILTER (abs({_FLAT}) <= 1.25 OR band) = 0 THEN 1e0 ELSE count(*) FILTER (abs({_FLAT}) <= 1.25 AND band) / CAST(count(*) FILTER (abs({_FLAT}) <= 1.25 OR band) AS DOUBLE) END AS boundary_iou,
 coalesce(least(1, avg(abs({_FLAT})) FILTER (edge) / sqrt({2 * SIDE * SIDE}e0)), 0) AS boundary_distance, sum(least(active::INT, CAST(coverage AS DOUBLE))) / sum(greatest(active::INT, CAST(coverage AS DOUBLE))) AS coverage_iou, count(*) FILTER (active) / {SIDE * SIDE}e0 AS occupancy
 FROM edge JOIN wide USING (image_id, x, y) GROUP BY image_id)""",
)


@query("WITH " + ",\n".join((*_RASTER, _NEAR, *_BANDS)) + f"\nSELECT image_id, {', '.join(f'{sql_r4(c)} AS {c}' for c in ('boundary_iou', 'boundary_distance', 'coverage_iou', 'occupancy'))}, 1e0 AS topology, {sql_r4('0.4 * boundary_iou + 0.4 * coverage_iou + 0.2')} AS structure FROM score")
def shape_scores(spark, sf_dir):
    """How well the raster before the search keeps the shape."""
    names = ("boundary_iou", "boundary_distance", "coverage_iou", "occupancy", "topology", "structure")
    return shapes.shape_scores(_made(spark, sf_dir, 0)).select("image_id", *(r4(F.col(c)).alias(c) for c in names))


_PARTS = (
    MASK, *_components("mask", "comp", "v >= 0.5", False), *_components("mask", "ground", "v < 0.5", True),
    "size AS (SELECT image_id, part, count(*) AS n, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, bool_or(x IN (0, 7) OR y IN (0, 7)) AS touches FROM comp GROUP BY ALL)",
    "hole AS (SELECT image_id, count(*) AS holes FROM (SELECT image_id, part FROM ground GROUP BY ALL HAVING NOT bool_or(x IN (0, 7) OR y IN (0, 7))) GROUP BY image_id)",
    "first AS (SELECT image_id, x, y, w, h FROM size QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, part) = 1)",
    "held AS (SELECT vec_id AS image_id, count(*) FILTER (vec_id % 3 = 0) * 2 AS anchors FROM embeddings GROUP BY vec_id)",
)


@query(recursive(*_PARTS) + """SELECT i.image_id, coalesce(area, 0)::BIGINT AS area, coalesce(parts, 0)::INTEGER AS components, coalesce(touching, 0)::INTEGER AS touching, coalesce(holes, 0)::INTEGER AS holes, f.x AS box_x, f.y AS box_y, f.w AS box_w, f.h AS box_h, anchors::INTEGER AS anchors
 FROM held i LEFT JOIN (SELECT image_id, sum(n) AS area, count(*) AS parts, count(*) FILTER (touches) AS touching FROM size GROUP BY image_id) s USING (image_id) LEFT JOIN hole USING (image_id) LEFT JOIN first f USING (image_id)""")  # fmt: skip
def shape_models(spark, sf_dir):
    """Foreground, components, holes, the largest component's box, and anchors of every third image."""
    marks = views.landmark(spark, sf_dir).withColumn("affects_occupancy", F.col("image_id") % 3 == 0)
    out = shapes.shape_models(views.mask(spark, sf_dir), marks)
    touching = F.size(F.filter("components", lambda c: c.touches))
    return out.select("image_id", "area", F.size("components").alias("components"), touching.alias("touching"), "holes", *(F.get(F.col("components"), 0)[k].alias(f"box_{n}") for n, k in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))), F.coalesce(F.size("anchors"), F.lit(0)).alias("anchors"))
