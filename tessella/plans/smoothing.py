"""Queries of clean-up that spares protected cells, of edge-aware smoothing, and of adaptation to fixed cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import cleanup, features, raster, relaxation
from tessella.plans.registry import ASSIGNED, LANDMARK, MASK, PALETTE, PIXEL, e2000_ctes, lab_ctes, query, r4, sql_r4
from tessella.sources import views

#: Regions of fewer cells go.
LEAST = 6


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _assigned(spark, sf_dir):
    return raster.assign_nearest(views.pixel(spark, sf_dir), raster.palette_rows(views.palette(spark, sf_dir)), "rgb")


def _coarse(spark, sf_dir):
    """Grids of three colours, whose regions have one to some twenty cells."""
    return _assigned(spark, sf_dir).withColumn("ord", 1 + F.col("ord") % 3)


def _protected(spark, sf_dir):
    marks = views.landmark(spark, sf_dir).withColumn("grid_radius", (F.col("image_id") % 4 == 0).cast("int"))
    return features.protected_cells(marks, views.pixel(spark, sf_dir))


_COARSE = "grid AS MATERIALIZED (SELECT image_id, x, y, 1 + ord % 3 AS ord FROM assigned)"
_HELD = "held AS MATERIALIZED (SELECT DISTINCT p.image_id, p.x, p.y FROM pixel p JOIN landmark m ON p.image_id = m.image_id AND abs(p.x - m.x) <= CAST(m.image_id % 4 = 0 AS INT) AND abs(p.y - m.y) <= CAST(m.image_id % 4 = 0 AS INT) WHERE m.priority = 'hard' AND m.confidence >= 0.5)"
#: A component is named by its smallest cell; each cell reaches those of its colour step by step.
_COMPONENTS = (
    "reach AS (SELECT image_id, x, y, ord, y * 8 + x AS root FROM grid UNION SELECT g.image_id, g.x, g.y, g.ord, r.root FROM reach r JOIN grid g ON g.image_id = r.image_id AND g.ord = r.ord AND abs(g.x - r.x) + abs(g.y - r.y) = 1)",
    "part AS MATERIALIZED (SELECT image_id, x, y, ord, min(root) AS component FROM reach GROUP BY ALL)",
    "sized AS MATERIALIZED (SELECT p.*, h.image_id IS NOT NULL AS protected, count(*) OVER w AS size, bool_or(h.image_id IS NOT NULL) OVER w AS spared FROM part p LEFT JOIN held h USING (image_id, x, y) WINDOW w AS (PARTITION BY p.image_id, component))",
)


def _regions(least: int) -> tuple[str, str]:
    return (
        f"votes AS (SELECT s.image_id, s.component, s.size, o.ord, count(*) AS n FROM sized s JOIN grid o ON s.image_id = o.image_id AND abs(s.x - o.x) + abs(s.y - o.y) = 1 AND s.ord <> o.ord WHERE size < {least} AND NOT spared GROUP BY ALL)",
        "pass1 AS MATERIALIZED (SELECT s.*, coalesce(v.ord, s.ord) AS regions FROM sized s LEFT JOIN (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY image_id, component ORDER BY n DESC, ord) = 1) v ON v.image_id = s.image_id AND v.component = s.component AND v.n > v.size)",
    )


_LATER = (
    "near2 AS (SELECT *, lag(regions) OVER r AS l, lead(regions) OVER r AS rt, lag(regions) OVER c AS t, lead(regions) OVER c AS bt FROM pass1 WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))",
    "two AS (SELECT *, CASE WHEN l = rt AND l <> regions THEN l END AS h, CASE WHEN t = bt AND t <> regions THEN t END AS v FROM near2)",
    "pass2 AS MATERIALIZED (SELECT * EXCLUDE (l, rt, t, bt, h, v), CASE WHEN protected OR l IS NULL OR rt IS NULL OR t IS NULL OR bt IS NULL OR (h IS NULL AND v IS NULL) THEN regions WHEN h IS NULL THEN v WHEN v IS NULL OR h = v THEN h ELSE regions END AS stripes FROM two)",
    "tally AS (SELECT a.image_id, a.x, a.y, o.stripes AS other, count(*) AS n, count(*) FILTER (abs(a.x - o.x) + abs(a.y - o.y) = 1) AS sides FROM pass2 a JOIN pass2 o ON a.image_id = o.image_id AND abs(a.x - o.x) <= 1 AND abs(a.y - o.y) <= 1 AND (a.x <> o.x OR a.y <> o.y) GROUP BY ALL)",
    "told AS (SELECT p.*, t.other, t.n, coalesce(own.n, 0) AS alike, coalesce(own.sides, 0) AS side FROM pass2 p LEFT JOIN (SELECT * FROM tally QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY n DESC, other) = 1) t USING (image_id, x, y) LEFT JOIN tally own ON own.image_id = p.image_id AND own.x = p.x AND own.y = p.y AND own.other = p.stripes)",
    "pass3 AS MATERIALIZED (SELECT *, CASE WHEN NOT protected AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND other <> stripes AND n >= 6 AND side <= 1 AND n - alike > 1 THEN other ELSE stripes END AS alias FROM told)",
)
_START = (PIXEL, PALETTE, ASSIGNED, _COARSE, LANDMARK, _HELD, *_COMPONENTS)
_EDITS = """step AS (SELECT image_id, pass, CASE WHEN pass = 0 THEN component ELSE 0 END AS first, x, y, CASE pass WHEN 0 THEN ord WHEN 1 THEN regions ELSE stripes END AS before,
 CASE pass WHEN 0 THEN regions WHEN 1 THEN stripes ELSE alias END AS after, CASE WHEN pass > 0 THEN pass + 2 WHEN size = 1 THEN 1 ELSE 2 END AS kind FROM pass3, (VALUES (0), (1), (2)) t(pass)),
edit AS MATERIALIZED (SELECT * EXCLUDE (kind, name), name AS reason FROM step JOIN (VALUES (1, 'isolated-cell'), (2, 'small-region'), (3, 'stripe'), (4, 'topology')) n(kind, name) USING (kind) WHERE before <> after)"""


@query(recursive(*_START, *_regions(LEAST)) + "SELECT image_id, x, y, CAST(regions AS INTEGER) AS ord FROM pass1")
def cleanup_small_regions(spark, sf_dir):
    """Regions of up to five cells, but none with a protected cell."""
    frame = cleanup.cleaned(_coarse(spark, sf_dir), _protected(spark, sf_dir), cleanup.Penalties(LEAST, stripe=0, alias=0))
    return cleanup.final_grid(frame)


@query(recursive(*_START, *_regions(LEAST), *_LATER) + "SELECT image_id, x, y, CAST(alias AS INTEGER) AS ord FROM pass3")
def cleanup_protected(spark, sf_dir):
    """All three passes, around protected cells."""
    return cleanup.final_grid(cleanup.cleaned(_coarse(spark, sf_dir), _protected(spark, sf_dir), cleanup.Penalties(LEAST)))


@query(recursive(*_START, *_regions(LEAST), *_LATER, _EDITS) + "SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pass, first, y, x) AS INTEGER) AS seq, x, y, before, after, reason FROM edit")
def cleanup_edits(spark, sf_dir):
    """What the three passes changed, in order."""
    return cleanup.edit_log(cleanup.cleaned(_coarse(spark, sf_dir), _protected(spark, sf_dir), cleanup.Penalties(LEAST)))


# Edge-aware smoothing: each image's grid is one list, and one step of the recursion settles one cell of every image.

_OWN = (
    PIXEL, PALETTE, LANDMARK, _HELD, MASK, lab_ctes("pixel", "seen"), lab_ctes("palette", "paint"),
    "pair AS (SELECT s.image_id, s.x, s.y, p.ord, s.l AS l1, s.la AS a1, s.lb AS b1, p.l AS l2, p.la AS a2, p.lb AS b2 FROM seen s, paint p)", e2000_ctes("pair", "far"),
    "first AS MATERIALIZED (SELECT image_id, x, y, arg_min(ord, (distance, ord)) AS ord FROM far GROUP BY ALL)",
    f"cost AS MATERIALIZED (SELECT f.image_id, f.x, f.y, list(distance * ({relaxation.OWN} + {relaxation.LIFT} * m.v) ORDER BY f.ord) AS c FROM far f JOIN mask m USING (image_id, x, y) GROUP BY ALL)",
    "step AS (SELECT a.image_id, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, 1.15e0 * 16 * (1 - 0.8e0 * least(1, sqrt(pow(a.l - b.l, 2) + pow(a.la - b.la, 2) + pow(a.lb - b.lb, 2)) / 60)) AS w FROM seen a JOIN seen b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1)",
    "side AS (SELECT image_id, x, y, max(w) FILTER (dx = -1) AS wl, max(w) FILTER (dx = 1) AS wr, max(w) FILTER (dy = -1) AS wt, max(w) FILTER (dy = 1) AS wb FROM step GROUP BY ALL)",
    "cell AS MATERIALIZED (SELECT image_id, x, y, y * 8 + x AS i, c, wl, wr, wt, wb, h.image_id IS NOT NULL AS fixed FROM cost JOIN side USING (image_id, x, y) LEFT JOIN held h USING (image_id, x, y))",
)


def _sweeps(start: str, steps: int) -> str:
    beside = " + ".join(f"CASE WHEN {w} IS NOT NULL AND labels[{at}] <> k THEN {w} ELSE 0 END" for w, at in (("wl", "i"), ("wr", "i + 2"), ("wt", "i - 7"), ("wb", "i + 9")))
    return f"""run AS (SELECT image_id, 0 AS step, {start} UNION ALL
 SELECT image_id, step + 1, CASE WHEN fixed THEN labels ELSE list_concat(labels[1:i], [CAST(list_position(e, list_min(e)) AS INTEGER)], labels[i + 2:64]) END FROM
 (SELECT r.image_id, step, labels, i, fixed, list_transform(c, lambda v, k: v + {beside}) AS e FROM run r JOIN cell ON cell.image_id = r.image_id AND cell.i = r.step % 64 WHERE step < {steps}))"""


_RELAXED = (*_OWN, _sweeps("list(CAST(ord AS INTEGER) ORDER BY y, x) AS labels FROM first GROUP BY image_id", 128))


def _weighed(spark, sf_dir):
    pixels, colors = views.pixel(spark, sf_dir), raster.palette_rows(views.palette(spark, sf_dir))
    marks = _protected(spark, sf_dir).withColumn("protected", F.lit(True))
    mask = views.mask(spark, sf_dir).select("image_id", "x", "y", F.col("v").alias("importance"))
    key = ["image_id", "x", "y"]
    cells = pixels.join(raster.assign_nearest(pixels, colors, "delta-e-2000"), key).join(mask, key).join(marks, key, "left")
    return cells, colors


@query(recursive(*_RELAXED) + "SELECT image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, labels[i + 1] AS ord FROM run, range(64) t(i) WHERE step = 128")
def icm_labels(spark, sf_dir):
    """Two sweeps with importance, edges and protected cells."""
    return relaxation.relaxed(*_weighed(spark, sf_dir))


_ENERGY = f"""SELECT image_id, CAST(step // 64 AS INTEGER) AS sweep, {sql_r4("sum(c[labels[i + 1]] + CASE WHEN wr IS NOT NULL AND labels[i + 1] <> labels[i + 2] THEN wr ELSE 0 END + CASE WHEN wb IS NOT NULL AND labels[i + 1] <> labels[i + 9] THEN wb ELSE 0 END)")} AS energy
 FROM run JOIN cell USING (image_id) WHERE step % 64 = 0 GROUP BY image_id, step"""


@query(recursive(*_RELAXED) + _ENERGY)
def icm_energies(spark, sf_dir):
    """Each image's energy before and after each sweep; it never rises."""
    return relaxation.relaxed(*_weighed(spark, sf_dir), energies=True).withColumn("energy", r4(F.col("energy")))


@query(recursive(*_RELAXED) + """SELECT r.image_id, CAST(row_number() OVER (PARTITION BY r.image_id ORDER BY y, x) AS INTEGER) AS seq, x, y, ord AS before, labels[y * 8 + x + 1] AS after, 'palette-coherence' AS reason
 FROM run r JOIN first USING (image_id) WHERE step = 128 AND ord <> labels[y * 8 + x + 1]""")  # fmt: skip
def icm_edits(spark, sf_dir):
    cells, colors = _weighed(spark, sf_dir)
    return relaxation.changed_labels(cells, relaxation.relaxed(cells, colors))


# Adaptation: cell (3, 3) takes colour 1, the two last rows stay, at most 12 cells change.

_ADAPTED = (
    PIXEL, PALETTE, ASSIGNED, lab_ctes("palette", "paint"), "pair AS (SELECT a.ord AS target, b.ord, a.l AS l1, a.la AS a1, a.lb AS b1, b.l AS l2, b.la AS a2, b.lb AS b2 FROM paint a, paint b)", e2000_ctes("pair", "far"),
    "cost AS (SELECT target, list(distance / 45e0 + CASE WHEN target <> ord THEN 0.35e0 ELSE 0 END ORDER BY ord) AS c FROM far GROUP BY target)",
    "cell AS MATERIALIZED (SELECT image_id, x, y, y * 8 + x AS i, target, c, CASE WHEN x > 0 THEN 1.4e0 END AS wl, CASE WHEN x < 7 THEN 1.4e0 END AS wr, CASE WHEN y > 0 THEN 1.4e0 END AS wt, CASE WHEN y < 7 THEN 1.4e0 END AS wb, y >= 6 OR (x = 3 AND y = 3) AS fixed FROM assigned JOIN cost ON ord = target)",
    _sweeps("list(CAST(CASE WHEN x = 3 AND y = 3 THEN 1 ELSE ord END AS INTEGER) ORDER BY y, x) AS labels FROM assigned GROUP BY image_id", 256),
    "done AS (SELECT image_id, x, y, target, labels[i + 1] AS settled, x = 3 AND y = 3 AS held FROM run JOIN cell USING (image_id) WHERE step = 256)",
    "adapted AS MATERIALIZED (SELECT *, NOT held AND settled <> target AND row_number() OVER (PARTITION BY image_id ORDER BY NOT held AND settled <> target DESC, abs(x - 3) + abs(y - 3), y, x) <= 12 AS changed FROM done)",
)


def _fixed(spark, sf_dir):
    fixed = F.when((F.col("x") == 3) & (F.col("y") == 3), 1)
    return _assigned(spark, sf_dir).select("*", fixed.alias("fixed"), (F.col("y") < 6).alias("editable")), raster.palette_rows(views.palette(spark, sf_dir))


@query(recursive(*_ADAPTED) + "SELECT image_id, x, y, target, CASE WHEN held OR changed THEN settled ELSE target END AS ord, changed FROM adapted")
def adapt_pattern(spark, sf_dir):
    return relaxation.adapted(*_fixed(spark, sf_dir), most_changes=12)


@query(recursive(*_ADAPTED) + f"SELECT image_id, count(*) FILTER (changed) AS changes, count(*) FILTER (held) AS preserved, {sql_r4('count(*) FILTER (changed) / 63e0')} AS deviation FROM adapted GROUP BY image_id")
def adaptation_report(spark, sf_dir):
    cells, colors = _fixed(spark, sf_dir)
    out = relaxation.adapted(cells, colors, most_changes=12).join(cells.select("image_id", "x", "y", "fixed"), ["image_id", "x", "y"])
    return relaxation.adaptation_report(out).withColumn("deviation", r4(F.col("deviation")))
