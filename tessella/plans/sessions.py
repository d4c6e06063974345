"""Queries of edit sessions: undo and redo, strokes along paths, overlays, and subjects found without a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import editing, subjects
from tessella.plans.registry import MASK, PIXEL, query, r4, sql_r4, with_
from tessella.sources import views

OPERATION = "SELECT user_id AS session, event_id AS ord, CASE WHEN event_id % 11 = 0 THEN 'confirm' WHEN event_type = 'click' THEN 'undo' WHEN event_type = 'error' THEN 'redo' ELSE 'append' END AS op FROM events"


def _operations(spark, sf_dir):
    return spark.sql(OPERATION.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


_STEP = """CASE e.op WHEN 'append' THEN {'ord': s.ord, 'op': s.op, 'strokes': list_append(s.strokes[1:s.cur], e.ord), 'cur': s.cur + 1, 'mark': s.mark}
 WHEN 'undo' THEN {'ord': s.ord, 'op': s.op, 'strokes': s.strokes, 'cur': greatest(0, s.cur - 1), 'mark': s.mark} WHEN 'redo' THEN {'ord': s.ord, 'op': s.op, 'strokes': s.strokes, 'cur': least(len(s.strokes), s.cur + 1), 'mark': s.mark}
 ELSE {'ord': s.ord, 'op': s.op, 'strokes': s.strokes, 'cur': s.cur, 'mark': array_to_string(s.strokes[1:s.cur], ' ')} END"""
_EMPTY = "'strokes': CAST([] AS BIGINT[]), 'cur': CAST(0 AS BIGINT), 'mark': CAST('none' AS VARCHAR)"


@query(
    f"""WITH log AS (SELECT session, list({{'ord': ord, 'op': op, {_EMPTY}}} ORDER BY ord) AS l FROM ({OPERATION}) GROUP BY session),
done AS (SELECT session, list_reduce(l, lambda s, e: {_STEP}, {{'ord': CAST(0 AS BIGINT), 'op': '', {_EMPTY}}}) AS s FROM log)
SELECT session, len(s.strokes) AS strokes, s.cur AS cursor, array_to_string(s.strokes[1:s.cur], ' ') AS active, s.mark <> array_to_string(s.strokes[1:s.cur], ' ') AS dirty FROM done"""
)
def session_replay(spark, sf_dir):
    out = editing.replayed_sessions(_operations(spark, sf_dir))
    return out.select("session", F.size("strokes").cast("long").alias("strokes"), F.col("cursor").cast("long").alias("cursor"), F.array_join("active", " ").alias("active"), "dirty")


# Strokes of three points, on masks that aren't empty.


def _paths(spark, sf_dir):
    n = F.length("text")
    place = lambda k: F.struct((n * k % 101 / 100).alias("x"), (n * (k + 4) % 101 / 100).alias("y"))
    points = F.when(F.col("turn") % 2 == 0, F.array(place(1), place(3), place(5))).otherwise(F.array(place(2)))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.when(F.col("role") == "assistant", "erase").otherwise("add").alias("mode"), F.lit(0.2).alias("radius"), points.alias("points"), F.lit(8).alias("width"), F.lit(8).alias("height"))


def _corrected(spark, sf_dir):
    base = views.mask(spark, sf_dir).select(F.col("image_id").alias("session"), "x", "y", "v")
    strokes = _paths(spark, sf_dir)
    edited = strokes.select("session").distinct()
    return editing.painted_over(strokes, base.join(edited, "session", "left_semi")), base


_PATHS_SQL = """turn_ AS (SELECT conv_id AS session, turn, CASE WHEN role = 'assistant' THEN 'erase' ELSE 'add' END AS mode, length(text) AS n, unnest(CASE WHEN turn % 2 = 0 THEN [1, 3, 5] ELSE [2] END) AS k, generate_subscripts(CASE WHEN turn % 2 = 0 THEN [1, 3, 5] ELSE [2] END, 1) AS nth FROM conversations),
point_ AS (SELECT session, turn, mode, nth, n * k % 101 / 100e0 * 7 AS px, n * (k + 4) % 101 / 100e0 * 7 AS py FROM turn_),
leg_ AS (SELECT *, lag(px) OVER w AS qx, lag(py) OVER w AS qy FROM point_ WINDOW w AS (PARTITION BY session, turn ORDER BY nth)),
step_ AS (SELECT *, CASE WHEN qx IS NULL THEN 1 ELSE greatest(1, ceil(sqrt((px-qx)*(px-qx) + (py-qy)*(py-qy)) / 0.8e0)) END AS steps FROM leg_),
touch_ AS (SELECT session, turn, mode, nth, s, CASE WHEN qx IS NULL THEN px ELSE qx + (px - qx) * (s / steps) END AS cx, CASE WHEN qx IS NULL THEN py ELSE qy + (py - qy) * (s / steps) END AS cy FROM (SELECT *, unnest(range(1, CAST(steps AS BIGINT) + 1)) AS s FROM step_)),
brush_ AS (SELECT session, CAST(x AS INT) AS x, CAST(y AS INT) AS y, list({'m': mode, 'b': 1 - sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) / 1.6e0} ORDER BY turn, nth, s) AS l FROM touch_, range(8) a(x), range(8) c(y) WHERE (x-cx)*(x-cx) + (y-cy)*(y-cy) <= 1.6e0*1.6e0 GROUP BY ALL),
corrected AS MATERIALIZED (SELECT m.image_id AS session, m.x, m.y, m.v AS base, CASE WHEN l IS NULL THEN m.v ELSE list_reduce(l, lambda s, e: {'m': '', 'b': CASE WHEN e.m = 'add' THEN greatest(s.b, e.b) ELSE least(s.b, 1 - e.b) END}, {'m': '', 'b': m.v}).b END AS v
 FROM mask m LEFT JOIN brush_ b ON m.image_id = b.session AND m.x = b.x AND m.y = b.y WHERE m.image_id IN (SELECT conv_id FROM conversations))"""


@query(with_(MASK, _PATHS_SQL) + f"SELECT session, x, y, {sql_r4('v')} AS v FROM corrected")
def paint_paths(spark, sf_dir):
    return _corrected(spark, sf_dir)[0].withColumn("v", r4(F.col("v")))


_DELTA = "greatest(0, least(1, v)) - greatest(0, least(1, base))"


@query(
    with_(MASK, _PATHS_SQL)
    + f"""SELECT session, x, y, CASE WHEN {_DELTA} > 0.01 THEN 'added' WHEN -({_DELTA}) > 0.01 THEN 'erased' WHEN base > 0.01 THEN 'base' ELSE 'none' END AS kind,
 CAST(CASE WHEN {_DELTA} > 0.01 THEN floor(168 * ({_DELTA}) + 0.5) WHEN -({_DELTA}) > 0.01 THEN floor(-168 * ({_DELTA}) + 0.5) WHEN base > 0.01 THEN floor(92 * base + 0.5) ELSE 0 END AS INT) AS alpha,
 CAST(floor(greatest(0, least(1, v)) * 255 + 0.5) AS INT) AS byte FROM corrected"""
)
def mask_overlay(spark, sf_dir):
    after, base = _corrected(spark, sf_dir)
    return editing.overlaid(base, after)


# Subjects without a model: transparency, else what the border doesn't reach.


def _rgba(spark, sf_dir):
    alpha = F.when((F.col("image_id") % 4 == 0) & (F.col("x") < 3), F.col("r")).otherwise(255)
    near = lambda c: F.floor(F.col(c) / 8).cast("int")  # noqa: E731 - flat images, so that a flood gets somewhere
    return views.pixel(spark, sf_dir).select("image_id", "x", "y", *(near(c).alias(c) for c in "rgb"), alpha.alias("a"))


_FLAT = """flat AS MATERIALIZED (SELECT image_id, x, y, r // 8 AS r, g // 8 AS g, b // 8 AS b, CASE WHEN image_id % 4 = 0 AND x < 3 THEN r ELSE 255 END AS a FROM pixel),
corner AS (SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, 0 AS z FROM flat WHERE x IN (0, 7) AND y IN (0, 7) GROUP BY image_id),
open_ AS MATERIALIZED (SELECT image_id, x, y FROM flat JOIN corner USING (image_id) WHERE sqrt((r-mr)*(r-mr)*0.3e0 + (g-mg)*(g-mg)*0.59e0 + (b-mb)*(b-mb)*0.11e0) <= 6),
seen AS (SELECT image_id, x, y FROM open_ WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT o.image_id, o.x, o.y FROM seen s JOIN open_ o ON o.image_id = s.image_id AND abs(o.x - s.x) + abs(o.y - s.y) = 1),
clear AS (SELECT image_id, bool_or(a / 255e0 < 0.98e0) AS has_alpha FROM flat GROUP BY image_id)"""


@query(
    "WITH RECURSIVE "
    + ",\n".join([PIXEL, _FLAT])
    + f"""
SELECT f.image_id, CASE WHEN has_alpha THEN 'alpha' ELSE 'border-flood' END AS source, {sql_r4("sum(CASE WHEN has_alpha THEN a / 255e0 WHEN s.x IS NULL THEN 1 ELSE 0 END)")} AS foreground,
 {sql_r4("CASE WHEN has_alpha THEN 1 ELSE least(0.92e0, avg(CASE WHEN s.x IS NULL THEN 0e0 ELSE 1e0 END) FILTER (f.x IN (0, 7) OR f.y IN (0, 7)) * CASE WHEN avg(CASE WHEN s.x IS NULL THEN 1e0 ELSE 0e0 END) > 0.01 AND avg(CASE WHEN s.x IS NULL THEN 1e0 ELSE 0e0 END) < 0.95 THEN 1 ELSE 0.35e0 END) END")} AS confidence
FROM flat f JOIN clear USING (image_id) LEFT JOIN seen s USING (image_id, x, y) GROUP BY f.image_id, has_alpha"""
)
def subject_without_model(spark, sf_dir):
    found = subjects.inferred(_rgba(spark, sf_dir), threshold=6.0)
    out = found.groupBy("image_id", "source", "confidence").agg(F.sum("v").alias("foreground"))
    return out.select("image_id", "source", r4(F.col("foreground")).alias("foreground"), r4(F.col("confidence")).alias("confidence"))
