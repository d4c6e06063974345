"""The registry of queries and of their DuckDB SQL, and the SQL texts of the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r4(c) -> F.Column:
    return F.floor(c * 1e4 + 0.5) / 1e4


# DuckDB texts of the views

PIXEL = """pixel AS MATERIALIZED (SELECT vec_id AS image_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y,
 CAST(greatest(0, least(255, floor((CAST(embedding[i+1] AS DOUBLE)+0.5e0)*255e0+0.5e0))) AS INT) AS r,
 CAST(greatest(0, least(255, floor((CAST(embedding[(i+21)%64+1] AS DOUBLE)+0.5e0)*255e0+0.5e0))) AS INT) AS g,
 CAST(greatest(0, least(255, floor((CAST(embedding[(i+42)%64+1] AS DOUBLE)+0.5e0)*255e0+0.5e0))) AS INT) AS b
 FROM embeddings, range(64) t(i))"""
MASK = """mask AS MATERIALIZED (SELECT vec_id AS image_id, label, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y,
 greatest(0e0, least(1e0, CAST(embedding[i+1] AS DOUBLE) + 0.5e0)) AS v FROM embeddings, range(64) t(i))"""
PALETTE = """palette AS MATERIALIZED (SELECT CAST(p_partkey AS INT) AS ord, concat('c', lpad(CAST(p_partkey AS VARCHAR), 3, '0')) AS color_id,
 CAST(p_partkey*53%256 AS INT) AS r, CAST(p_partkey*97%256 AS INT) AS g, CAST(p_partkey*193%256 AS INT) AS b FROM part WHERE p_partkey BETWEEN 1 AND 24)"""
INTERACTION = f"interaction AS MATERIALIZED ({views.INTERACTION})"
PREFERENCE = """preference AS (SELECT image_id, rater_id, CASE image_id % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'right' ELSE 'left' END AS choice,
 CASE WHEN image_id % 2 = 0 THEN 'before' ELSE 'after' END AS left_variant FROM interaction WHERE outcome = 'confirmed')"""
LANDMARK = """landmark AS (SELECT vec_id AS image_id, CASE WHEN s = 0 THEN label % 4 ELSE 7 - label % 4 END AS x, 3 AS y,
 CASE WHEN vec_id % 3 = 0 THEN 0.4e0 ELSE 1e0 END AS confidence, CASE WHEN vec_id % 2 = 0 THEN 'hard' ELSE 'soft' END AS priority,
 vec_id % 2 AS grid_radius, s FROM embeddings, (VALUES (0), (1)) v(s))"""
EVIDENCE = """evidence AS (SELECT label AS image_id, vec_id AS evidence_id, CAST(vec_id % 10 AS DOUBLE) / 10 AS confidence, vec_id % 17 = 0 AS user_confirmed, CAST(vec_id % 7 AS INT) AS source_priority FROM embeddings)"""
ASSIGNED = """assigned AS MATERIALIZED (SELECT image_id, x, y, ord FROM (SELECT p.image_id, p.x, p.y, c.ord,
 row_number() OVER (PARTITION BY p.image_id, p.x, p.y ORDER BY (p.r-c.r)*(p.r-c.r)+(p.g-c.g)*(p.g-c.g)+(p.b-c.b)*(p.b-c.b), c.ord) AS nth FROM pixel p, palette c) WHERE nth = 1)"""
NEAR = """near AS MATERIALIZED (SELECT *, lag(ord) OVER r AS l, lead(ord) OVER r AS rt, lag(ord) OVER c AS t, lead(ord) OVER c AS bt FROM assigned
 WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"""


def _linear(c: str) -> str:
    return f"(CASE WHEN {c} / 255e0 <= 0.04045 THEN {c} / 255e0 / 12.92 ELSE pow(({c} / 255e0 + 0.055) / 1.055, 2.4e0) END)"


def lab_ctes(source: str, name: str) -> str:
    """A CTE with l, la, lb for the r, g, b of a CTE."""
    x, y, z = (" + ".join(f"{_linear(c)} * {k}" for c, k in zip("rgb", row, strict=True)) for row in color.XYZ)
    f = lambda t: f"(CASE WHEN {t} > pow(6e0/29, 3) THEN cbrt({t}) ELSE {t} / (3 * pow(6e0/29, 2)) + 4e0/29 END)"
    return f"""{name}0 AS (SELECT *, ({x}) / 0.95047e0 AS fx, ({y}) AS fy, ({z}) / 1.08883e0 AS fz FROM {source}),
{name} AS MATERIALIZED (SELECT * EXCLUDE (fx, fy, fz), 116 * {f('fy')} - 16 AS l, 500 * ({f('fx')} - {f('fy')}) AS la, 200 * ({f('fy')} - {f('fz')}) AS lb FROM {name}0)"""


def sql_r4(e: str) -> str:
    return f"floor(({e}) * 1e4 + 0.5) / 1e4"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


LUM = "(r * 0.2126e0 + g * 0.7152e0 + b * 0.0722e0)"


def e2000_ctes(source: str, name: str) -> str:
    """CTEs that add distance (CIEDE2000) to a CTE with l1, a1, b1, l2, a2, b2."""
    hue = lambda b, a: f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END)"
    high = lambda c: f"sqrt(pow({c}, 7) / (pow({c}, 7) + pow(25e0, 7)))"
    return f"""{name}_1 AS (SELECT *, 1 + 0.5 * (1 - {high('((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2)')}) AS g_ FROM {source}),
{name}_2 AS (SELECT *, sqrt(a1*g_*a1*g_+b1*b1) AS c1_, sqrt(a2*g_*a2*g_+b2*b2) AS c2_, {hue('b1', 'a1*g_')} AS h1_, {hue('b2', 'a2*g_')} AS h2_ FROM {name}_1),
{name}_3 AS (SELECT *, (l1+l2)/2 AS lm_, (c1_+c2_)/2 AS cb_, CASE WHEN c1_*c2_ = 0 THEN 0 WHEN abs(h2_-h1_) <= 180 THEN h2_-h1_ WHEN h2_ > h1_ THEN h2_-h1_-360 ELSE h2_-h1_+360 END AS dh_,
 CASE WHEN c1_*c2_ = 0 THEN h1_+h2_ WHEN abs(h1_-h2_) <= 180 THEN (h1_+h2_)/2 WHEN h1_+h2_ < 360 THEN (h1_+h2_+360)/2 ELSE (h1_+h2_-360)/2 END AS hm_ FROM {name}_2),
{name}_4 AS (SELECT *, 1 - 0.17*cos(radians(hm_-30)) + 0.24*cos(radians(2*hm_)) + 0.32*cos(radians(3*hm_+6)) - 0.2*cos(radians(4*hm_-63)) AS t_, -2*{high('cb_')}*sin(radians(60*exp(-pow((hm_-275)/25,2)))) AS rt_,
 (l2-l1)/(1+0.015*pow(lm_-50,2)/sqrt(20+pow(lm_-50,2))) AS dl_, (c2_-c1_)/(1+0.045*cb_) AS dc_ FROM {name}_3),
{name}_5 AS (SELECT *, 2*sqrt(c1_*c2_)*sin(radians(dh_/2))/(1+0.015*cb_*t_) AS dhh_ FROM {name}_4),
{name} AS (SELECT * EXCLUDE (g_, c1_, c2_, h1_, h2_, lm_, cb_, dh_, hm_, t_, rt_, dl_, dc_, dhh_), sqrt(dl_*dl_+dc_*dc_+dhh_*dhh_+rt_*dc_*dhh_) AS distance FROM {name}_5)"""
