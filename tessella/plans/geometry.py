"""Queries of geometry: crops and fits, resampling of images of any size, viewports, texts at the borders of the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars
from tessella.operators import generate, resize
from tessella.plans.registry import PALETTE, e2000_ctes, lab_ctes, query, r4, sql_r4
from tessella.sources import views

# Frames of any size, one for each part; the text holds in both engines.
FRAME = """SELECT p_partkey AS id, CAST(20 + p_partkey % 50 AS INT) AS width, CAST(15 + p_partkey * 7 % 60 AS INT) AS height, p_partkey * 3 % 40 - 5.5e0 AS cx, p_partkey % 30 - 3.25e0 AS cy, p_partkey % 45 + 2.5e0 AS cw, p_partkey % 33 + 1.75e0 AS ch,
 CAST(8 + p_partkey % 25 AS INT) AS tw, CAST(8 + p_partkey % 17 AS INT) AS th FROM part"""


def _frames(spark, sf_dir):
    return spark.sql(FRAME.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


_FIT_SQL = f"""crop0 AS (SELECT *, greatest(0, least(width - 1, floor(cx))) AS x, greatest(0, least(height - 1, floor(cy))) AS y, greatest(0, least(width - 1, cx)) AS l, greatest(0, least(height - 1, cy)) AS t FROM ({FRAME})),
crop1 AS (SELECT *, greatest(1, least(width - x, floor(cw))) AS w, greatest(1, least(height - y, floor(ch))) AS h, greatest(l + 1, least(width, cx + cw)) - l AS pw, greatest(t + 1, least(height, cy + ch)) - t AS ph FROM crop0),
fit0 AS (SELECT *, greatest(1, least(tw, floor(w * least(tw / w, th / h) + 0.5))) AS fw, greatest(1, least(th, floor(h * least(tw / w, th / h) + 0.5))) AS fh FROM crop1),
fit1 AS MATERIALIZED (SELECT *, floor((tw - fw) / 2) AS fx, floor((th - fh) / 2) AS fy FROM fit0)"""
_CROP_SQL = _FIT_SQL + """,
point AS (SELECT *, CASE WHEN gx >= fx AND gy >= fy AND gx < fx + fw AND gy < fy + fh THEN x + (gx - fx + 0.5) * w / fw - 0.5 END AS sx, CASE WHEN gx >= fx AND gy >= fy AND gx < fx + fw AND gy < fy + fh THEN y + (gy - fy + 0.5) * h / fh - 0.5 END AS sy FROM (SELECT *, id % tw AS gx, id % th AS gy FROM fit1))"""


@query(
    f"WITH {_CROP_SQL} SELECT id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('x', 'y', 'w', 'h', 'fx', 'fy', 'fw', 'fh'))}, {', '.join(f'{sql_r4(c)} AS {c}' for c in ('l', 't', 'pw', 'ph', 'sx', 'sy'))},"
    " CASE WHEN sx IS NOT NULL THEN CAST(greatest(fx, least(fx + fw - 1, fx + floor((sx - x) / w * fw))) AS BIGINT) END AS bx, CASE WHEN sy IS NOT NULL THEN CAST(greatest(fy, least(fy + fh - 1, fy + floor((sy - y) / h * fh))) AS BIGINT) END AS by_, CAST(fw * fh AS BIGINT) AS active FROM point"
)
def crop_geometry(spark, sf_dir):
    """Crops within their image, whole and fractional, their fit on a canvas, and a cell's way to the source and back."""
    crop = scalars.whole_crop(F.col("width"), F.col("height"), *map(F.col, ("cx", "cy", "cw", "ch")))
    part = scalars.fractional_crop(F.col("width"), F.col("height"), *map(F.col, ("cx", "cy", "cw", "ch")))
    rows = _frames(spark, sf_dir).select("id", "tw", "th", crop.alias("c"), part.alias("p"))
    rows = rows.withColumn("f", scalars.fit_crop(F.col("c.width"), F.col("c.height"), F.col("tw"), F.col("th")))
    rows = rows.withColumn("s", scalars.source_point(F.col("c"), F.col("f"), F.col("id") % F.col("tw"), F.col("id") % F.col("th")))
    rows = rows.withColumn("b", F.when(F.col("s").isNotNull(), scalars.grid_cell(F.col("c"), F.col("f"), F.col("s.x"), F.col("s.y"))))
    whole = {"x": "c.x", "y": "c.y", "w": "c.width", "h": "c.height", "fx": "f.x", "fy": "f.y", "fw": "f.width", "fh": "f.height", "bx": "b.x", "by_": "b.y"}
    real = {"l": "p.x", "t": "p.y", "pw": "p.width", "ph": "p.height", "sx": "s.x", "sy": "s.y"}
    return rows.select("id", *(F.col(v).cast("long").alias(k) for k, v in whole.items()), *(r4(F.col(v)).alias(k) for k, v in real.items()), (F.col("f.width") * F.col("f.height")).cast("long").alias("active"))


@query(
    f"""WITH f AS ({FRAME}), v AS (SELECT *, least(tw * 40e0 / width, th * 40e0 / height) AS s, least(1e0, 24e0 / width, 24e0 / height, sqrt(700e0 / (width * height))) AS k FROM f),
d AS (SELECT *, greatest(1, floor(width * k + 0.5)) AS dw, greatest(1, floor(height * k + 0.5)) AS dh FROM v)
SELECT id, {sql_r4('(tw * 40 - width * s) / 2')} AS box_x, {sql_r4('(th * 40 - height * s) / 2')} AS box_y, {sql_r4('s')} AS scale, {sql_r4('greatest(0, least(1, (cx - 2) / cw))')} AS px, {sql_r4('greatest(0, least(1, (cy - 2) / ch))')} AS py,
 CAST(dw AS BIGINT) AS dw, CAST(dh AS BIGINT) AS dh, abs(dw / dh / (width / CAST(height AS DOUBLE)) - 1) <= 0.01 AS keeps_aspect,
 CASE WHEN width * 20 <= 600 THEN 'mobile' WHEN width * 20 <= 900 THEN 'tablet' ELSE 'desktop' END AS device, CASE WHEN id % 5 = 0 THEN 'pen' WHEN id % 3 > 0 THEN 'touch' ELSE 'mouse' END AS modality,
 CAST(CASE WHEN id % 3 = 0 THEN greatest(0, floor(cy + 0.5)) WHEN id % 3 = 1 THEN 0 ELSE greatest(0, floor(greatest(0, cx) * greatest(tw / cw, th / ch) + 0.5)) END AS BIGINT) AS grid_radius,
 CAST(CASE WHEN id % 2 = 0 THEN 0 ELSE greatest(1, 2 * greatest(0, floor(cy)) + 1) END AS BIGINT) AS anchor_cells, {sql_r4('greatest(0, least(1, cx / 20))')} AS confidence,
 CAST(greatest(1, floor(tw * CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.65e0 WHEN 3 THEN 0.85e0 ELSE 0.8e0 END + 0.5)) AS BIGINT) AS colors FROM d"""
)
def viewport_scalars(spark, sf_dir):
    c = F.col
    rows = _frames(spark, sf_dir).withColumn("box", scalars.contain_rect(c("width"), c("height"), c("tw") * 40.0, c("th") * 40.0)).withColumn("d", scalars.fitted_source(c("width"), c("height"), 24, 700))
    pointer = scalars.pointer_point(c("cx"), c("cy"), F.lit(2.0), F.lit(2.0), c("cw"), c("ch"))
    radius = scalars.landmark_radius(F.when(c("id") % 3 == 0, c("cy")), F.when(c("id") % 3 == 2, c("cx")), F.greatest(c("tw") / c("cw"), c("th") / c("ch")))
    limit = scalars.style_limit(c("tw"), F.element_at(F.array(*map(F.lit, ("faithful", "cute", "simple", "high-contrast", "soft"))), (c("id") % 5 + 1).cast("int")))
    return rows.select(
        "id", r4(c("box.x")).alias("box_x"), r4(c("box.y")).alias("box_y"), r4(c("box.scale")).alias("scale"), r4(pointer["x"]).alias("px"), r4(pointer["y"]).alias("py"), c("d.width").alias("dw"), c("d.height").alias("dh"), c("d.keeps_aspect").alias("keeps_aspect"),
        scalars.device_class(c("width") * 20).alias("device"), scalars.modality(F.when(c("id") % 5 == 0, "pen"), c("id") % 3).alias("modality"), radius.alias("grid_radius"),
        scalars.anchor_cells(F.when(c("id") % 2 == 0, "soft").otherwise("hard"), c("cy")).alias("anchor_cells"), r4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("cx") / 20))).alias("confidence"), limit.alias("colors"),
    )


# Images of any size with transparency, crops and margins.

_IMAGE = """SELECT vec_id AS image_id, CAST(5 + vec_id % 4 AS INT) AS width, CAST(4 + vec_id % 5 AS INT) AS height, vec_id % 3 - 0.5e0 AS cx, vec_id % 2 + 0.25e0 AS cy, 2 + vec_id % 5 + 0.5e0 AS cw, 3 + vec_id % 4 + 0.75e0 AS ch,
 CAST(2 + label % 9 AS INT) AS tw, CAST(3 + label % 7 AS INT) AS th, CASE vec_id % 3 WHEN 0 THEN 'nearest' WHEN 1 THEN 'bilinear' ELSE 'area' END AS method FROM embeddings"""


def _images(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frames = spark.sql(_IMAGE.replace("FROM embeddings", "FROM {embeddings}"), embeddings=rows)
    sized = rows.select(F.col("vec_id").alias("image_id"), "embedding", (5 + F.col("vec_id") % 4).alias("w"), (4 + F.col("vec_id") % 5).alias("h"))
    at = sized.select("*", F.explode(F.sequence(F.lit(0), (F.col("w") * F.col("h") - 1).cast("int"))).alias("i"))
    byte = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.element_at("embedding", ((F.col("i") + k) % 64 + 1).cast("int")).cast("double") + 0.5) * 255 + 0.5))).cast("int")
    pixels = at.select("image_id", (F.col("i") % F.col("w")).cast("int").alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), byte(0).alias("r"), byte(21).alias("g"), byte(42).alias("b"), F.when(F.col("i") % 3 == 0, byte(7)).otherwise(255).alias("a"))
    return frames, pixels


_BYTE = "CAST(greatest(0, least(255, floor((CAST(embedding[(i + {k}) % 64 + 1] AS DOUBLE) + 0.5e0) * 255e0 + 0.5e0))) AS INT)"
_TAPS = """CASE WHEN method = 'nearest' THEN [{{'p': floor({s} + 0.5), 'f': 1e0}}] WHEN method = 'bilinear' OR w < fw OR h < fh THEN [{{'p': floor({s}), 'f': 1 - ({s} - floor({s}))}}, {{'p': floor({s}) + 1, 'f': {s} - floor({s})}}]
 ELSE list_transform(range(CAST(floor({l}) AS BIGINT), CAST(ceil({r}) AS BIGINT)), lambda p: {{'p': CAST(p AS DOUBLE), 'f': least({r}, p + 1) - greatest({l}, p)}}) END"""
_RESIZE = f"""WITH {_FIT_SQL.replace(FRAME, _IMAGE)},
px AS MATERIALIZED (SELECT vec_id AS image_id, i % (5 + vec_id % 4) AS x, i // (5 + vec_id % 4) AS y, {_BYTE.format(k=0)} AS r, {_BYTE.format(k=21)} AS g, {_BYTE.format(k=42)} AS b, CASE WHEN i % 3 = 0 THEN {_BYTE.format(k=7)} ELSE 255 END AS a
 FROM embeddings, range(64) t(i) WHERE i < (5 + vec_id % 4) * (4 + vec_id % 5)),
flat AS MATERIALIZED (SELECT image_id, x, y, {', '.join(f'floor({c} * (a / 255e0) + 255 * (1 - a / 255e0) + 0.5) AS {c}' for c in 'rgb')} FROM px),
cells AS (SELECT f.*, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, gx >= fx AND gy >= fy AND gx < fx + fw AND gy < fy + fh AS active FROM fit1 f, range(12) a(gx), range(12) b(gy) WHERE gx < tw AND gy < th),
src AS (SELECT *, x + (gx - fx + 0.5) * w / fw - 0.5 AS sx, y + (gy - fy + 0.5) * h / fh - 0.5 AS sy, x + (gx - fx) * (w / fw) AS lx, least(x + w, x + (gx - fx + 1) * (w / fw)) AS rx, y + (gy - fy) * (h / fh) AS ty, least(y + h, y + (gy - fy + 1) * (h / fh)) AS by_ FROM cells WHERE active),
tap AS (SELECT image_id, gx, gy, width, height, tx, unnest(t2) AS ty FROM (SELECT image_id, gx, gy, width, height, unnest({_TAPS.format(s='sx', l='lx', r='rx')}) AS tx, {_TAPS.format(s='sy', l='ty', r='by_')} AS t2 FROM src)),
mixed AS (SELECT t.image_id, gx, gy, {', '.join(f'floor(round(sum(tx.f * ty.f * {c}) / sum(tx.f * ty.f), 9) + 0.5) AS {c}' for c in 'rgb')} FROM tap t JOIN flat p ON p.image_id = t.image_id AND p.x = greatest(0, least(width - 1, tx.p)) AND p.y = greatest(0, least(height - 1, ty.p)) GROUP BY ALL)
SELECT c.image_id, c.gx AS x, c.gy AS y, active, {', '.join(f'CAST(coalesce({c}, 255) AS INT) AS {c}' for c in 'rgb')} FROM cells c LEFT JOIN mixed m ON m.image_id = c.image_id AND m.gx = c.gx AND m.gy = c.gy"""


@query(_RESIZE)
def resize_fit(spark, sf_dir):
    frames, pixels = _images(spark, sf_dir)
    return resize.resized(frames, pixels)


# Patterns from images of any size.

_A0 = generate.Options(((3, 4), (5, 4)), max_colors=3, baseline="a0", most=5)


def _a0_sql(k: int) -> str:
    """The plain baseline: nearest pixels, k colours by summed distance, each cell's nearest of these, and measures."""
    source = _RESIZE[: _RESIZE.index("SELECT c.image_id, c.gx AS x")]
    frames = _IMAGE.replace("CAST(2 + label % 9 AS INT) AS tw, CAST(3 + label % 7 AS INT) AS th, CASE vec_id % 3 WHEN 0 THEN 'nearest' WHEN 1 THEN 'bilinear' ELSE 'area' END AS method FROM embeddings", "w_ AS tw, 4 AS th, 'nearest' AS method FROM embeddings, (VALUES (3), (5)) s(w_)")
    source = source.replace(_IMAGE, frames).replace("SELECT image_id, gx, gy, width", "SELECT image_id, tw, gx, gy, width").replace("tap AS (SELECT image_id, gx", "tap AS (SELECT image_id, tw, gx").replace("mixed AS (SELECT t.image_id, gx, gy", "mixed AS (SELECT t.image_id, tw, gx, gy")
    ctes = [
        source.rstrip(), "pixel AS MATERIALIZED (SELECT image_id * 2 + CASE tw WHEN 3 THEN 0 ELSE 1 END AS image_id, gx AS x, gy AS y, r, g, b FROM mixed)", PALETTE, lab_ctes("pixel", "pl"), lab_ctes("palette", "cl"),
        "d AS MATERIALIZED (SELECT p.image_id, p.x, p.y, c.ord, sqrt(pow(p.l-c.l,2)+pow(p.la-c.la,2)+pow(p.lb-c.lb,2)) AS d FROM pl p, cl c)", "best0 AS (SELECT image_id, x, y, CAST('inf' AS DOUBLE) AS b FROM pl)", "chosen0 AS (SELECT image_id, CAST([] AS INT[]) AS ords FROM pl GROUP BY image_id)",
    ]
    for i in range(k):
        ctes.append(f"pick{i} AS MATERIALIZED (SELECT image_id, ord FROM (SELECT image_id, ord, row_number() OVER (PARTITION BY image_id ORDER BY round(sum(least(d, b)), 6), ord) AS nth FROM d JOIN best{i} USING (image_id, x, y) JOIN chosen{i} USING (image_id) WHERE NOT list_contains(ords, ord) GROUP BY image_id, ord) WHERE nth = 1)")
        ctes.append(f"chosen{i + 1} AS MATERIALIZED (SELECT image_id, list_append(ords, ord) AS ords FROM chosen{i} JOIN pick{i} USING (image_id))")
        ctes.append(f"best{i + 1} AS MATERIALIZED (SELECT image_id, x, y, least(b, d) AS b FROM best{i} JOIN pick{i} USING (image_id) JOIN d USING (image_id, x, y, ord))")
    ctes += [
        f"assigned AS MATERIALIZED (SELECT image_id, x, y, ord FROM (SELECT p.image_id, p.x, p.y, c.ord, row_number() OVER (PARTITION BY p.image_id, p.x, p.y ORDER BY (p.r-c.r)*(p.r-c.r)+(p.g-c.g)*(p.g-c.g)+(p.b-c.b)*(p.b-c.b), c.ord) AS nth FROM pixel p JOIN chosen{k} USING (image_id) JOIN palette c ON list_contains(ords, c.ord)) WHERE nth = 1)",
        "pairs AS (SELECT a.image_id, p.l AS l1, p.la AS a1, p.lb AS b1, c.l AS l2, c.la AS a2, c.lb AS b2 FROM assigned a JOIN pl p USING (image_id, x, y) JOIN cl c USING (ord))", e2000_ctes("pairs", "far"), "mean_ AS (SELECT image_id, avg(distance) AS plan FROM far GROUP BY image_id)",
        "counts AS (SELECT image_id, count(*) AS cells, count(DISTINCT ord) AS colors FROM assigned GROUP BY image_id)",
    ]
    return ",\n".join(ctes).replace(",,", ",") + f"\nSELECT image_id // 2 AS image_id, CASE image_id % 2 WHEN 0 THEN '3x4' ELSE '5x4' END AS size, 'faithful' AS style, cells, colors, {sql_r4('plan')} AS plan FROM counts JOIN mean_ USING (image_id)"


def _generated(spark, sf_dir, options):
    frames, pixels = _images(spark, sf_dir)
    return generate.candidates(frames.drop("tw", "th", "method"), pixels, views.palette(spark, sf_dir), options)


@query(_a0_sql(3))
def generate_candidates(spark, sf_dir):
    """The plain baseline on two canvases: cells, colours and mean distance of each candidate."""
    out = _generated(spark, sf_dir, _A0)[1]
    return out.select("image_id", "size", "style", "cells", "colors", r4(F.col("plan")).alias("plan"))


_SAME = "sqrt(pow({0}.l - {1}.l, 2) + pow({0}.la - {1}.la, 2) + pow({0}.lb - {1}.lb, 2)) >= 12"
_MEASURES_SQL = (
    f"adj AS MATERIALIZED (SELECT a.image_id, a.x, a.y, a.ord AS o1, b.ord AS o2, b.x - a.x AS dx, b.y - a.y AS dy, {_SAME.format('p', 'q')} AS edge FROM assigned a JOIN assigned b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 JOIN pl p ON p.image_id = a.image_id AND p.x = a.x AND p.y = a.y JOIN pl q ON q.image_id = b.image_id AND q.x = b.x AND q.y = b.y)",
    "edges AS (SELECT image_id, avg(CAST(edge = (o1 <> o2) AS INT)) AS agreement FROM adj WHERE dx = 1 OR dy = 1 GROUP BY image_id)",
    "side AS (SELECT image_id, x, y, count(*) FILTER (o1 = o2) AS same, max(o2) FILTER (dx = -1) AS le, max(o2) FILTER (dx = 1) AS ri, max(o2) FILTER (dy = -1) AS up, max(o2) FILTER (dy = 1) AS lo FROM adj GROUP BY ALL)",
    "grid AS (SELECT a.image_id, count(*) FILTER (coalesce(same, 0) = 0) AS isolated, count(*) FILTER (le IS NOT NULL AND ri IS NOT NULL AND up IS NOT NULL AND lo IS NOT NULL AND ((le = ri AND le <> ord) OR (up = lo AND up <> ord))) AS stripes FROM assigned a LEFT JOIN side USING (image_id, x, y) GROUP BY a.image_id)",
    # The reference raster has 96 x 96 cells, but few different pairs of a pixel and a cell of the candidate along each axis.
    "big AS (SELECT *, image_id * 2 + CASE tw WHEN 3 THEN 0 ELSE 1 END AS number, greatest(1, least(96, floor(w * least(96 / w, 96 / h) + 0.5))) AS rw, greatest(1, least(96, floor(h * least(96 / w, 96 / h) + 0.5))) AS rh FROM fit1)",
    "xs AS MATERIALIZED (SELECT number, image_id, i, greatest(0, least(width - 1, floor(x + (i + 0.5) * w / rw))) AS p, fx + least(fw - 1, floor((i + 0.5) / rw * fw)) AS c FROM big, range(96) t(i) WHERE i < rw)",
    "ys AS MATERIALIZED (SELECT number, image_id, i, greatest(0, least(height - 1, floor(y + (i + 0.5) * h / rh))) AS p, fy + least(fh - 1, floor((i + 0.5) / rh * fh)) AS c FROM big, range(96) t(i) WHERE i < rh)",
    *(f"{n}1 AS MATERIALIZED (SELECT number, image_id, p, c, count(*) AS n FROM {n} GROUP BY ALL)" for n in ("xs", "ys")),
    *(f"{n}2 AS MATERIALIZED (SELECT a.number, a.image_id, a.p, a.c, b.p AS p2, b.c AS c2, count(*) AS n FROM {n} a JOIN {n} b ON a.number = b.number AND b.i = a.i + 1 GROUP BY ALL)" for n in ("xs", "ys")),
    lab_ctes("flat", "fl"),
    "under AS (SELECT u.number, u.n * v.n AS n, p.l AS l1, p.la AS a1, p.lb AS b1, k.l AS l2, k.la AS a2, k.lb AS b2 FROM xs1 u JOIN ys1 v USING (number, image_id) JOIN assigned a ON a.image_id = number AND a.x = u.c AND a.y = v.c JOIN fl p ON p.image_id = u.image_id AND p.x = u.p AND p.y = v.p JOIN cl k ON k.ord = a.ord)",
    e2000_ctes("under", "away"),
    "apart AS (SELECT number, sum(n * distance) / sum(n) AS distance FROM away GROUP BY number)",
    f"""step AS (SELECT u.number, u.n * v.n AS n, ({_SAME.format('p', 'q')}) = (a.ord <> b.ord) AS agrees FROM xs2 u JOIN ys1 v USING (number, image_id) JOIN assigned a ON a.image_id = number AND a.x = u.c AND a.y = v.c JOIN assigned b ON b.image_id = number AND b.x = u.c2 AND b.y = v.c JOIN fl p ON p.image_id = u.image_id AND p.x = u.p AND p.y = v.p JOIN fl q ON q.image_id = u.image_id AND q.x = u.p2 AND q.y = v.p
 UNION ALL SELECT u.number, u.n * v.n, ({_SAME.format('p', 'q')}) = (a.ord <> b.ord) FROM xs1 u JOIN ys2 v USING (number, image_id) JOIN assigned a ON a.image_id = number AND a.x = u.c AND a.y = v.c JOIN assigned b ON b.image_id = number AND b.x = u.c AND b.y = v.c2 JOIN fl p ON p.image_id = u.image_id AND p.x = u.p AND p.y = v.p JOIN fl q ON q.image_id = u.image_id AND q.x = u.p AND q.y = v.p2)""",
    "agreed AS (SELECT number, sum(CASE WHEN agrees THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS agreement FROM step GROUP BY number)",
    "known AS (SELECT image_id AS number, cells, colors, plan, coalesce(edges.agreement, 1) AS edges, isolated, stripes, distance AS reference, agreed.agreement AS reference_edges FROM counts JOIN mean_ USING (image_id) LEFT JOIN edges USING (image_id) JOIN grid USING (image_id) JOIN apart ON number = image_id JOIN agreed ON agreed.number = image_id)",
)
_KNOWN_SQL = ",\n".join((_a0_sql(3).rsplit("\nSELECT image_id // 2", 1)[0], *_MEASURES_SQL))
_TOTAL_SQL = """scored AS (SELECT *, 1 / (1 + (0.35 * plan + 0.65 * reference) / 15) * 0.24 + 1 / (1 + plan / 15) * 0.09 + (0.5 * edges + 0.5 * reference_edges) * 0.22 + greatest(0, least(1, 1 - (2 * isolated + stripes) / CAST(cells AS DOUBLE))) * 0.14
 + greatest(0, least(1, 1 - 0.25 * colors / 3 - isolated / CAST(cells AS DOUBLE))) * 0.05 + 1 / (1 + cells / 1024e0) * 0.08 AS w FROM known),
named AS (SELECT number // 2 AS image_id, CASE number % 2 WHEN 0 THEN '3x4' ELSE '5x4' END AS size, round(greatest(0, least(1, w / 0.82 + 0.015)), 9) AS total FROM scored)"""


@query(f"{_KNOWN_SQL}\nSELECT number // 2 AS image_id, CASE number % 2 WHEN 0 THEN '3x4' ELSE '5x4' END AS size, isolated, stripes, {', '.join(f'{sql_r4(c)} AS {c}' for c in ('edges', 'reference', 'reference_edges'))} FROM known")
def candidate_measures(spark, sf_dir):
    """The plain baseline's edges and grid quality, and how each candidate looks beside a reference raster of 96 x 96 cells."""
    out = _generated(spark, sf_dir, _A0)[1]
    return out.select("image_id", "size", "isolated", "stripes", *(r4(F.col(c)).alias(n) for c, n in (("plan_edges", "edges"), ("reference", "reference"), ("reference_edges", "reference_edges"))))


@query(f"{_KNOWN_SQL},\n{_TOTAL_SQL}\nSELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY total DESC, size) AS INTEGER) AS nth, size, 'faithful' AS style, {sql_r4('total')} AS total, true AS valid, 'success' AS status FROM named")
def generate_ranked(spark, sf_dir):
    """The plain baseline on two canvases, candidates scored and ranked."""
    out = generate.ranked(_generated(spark, sf_dir, _A0)[1], _A0)
    return out.withColumn("total", r4(F.col("total")))


_MVP = generate.Options(((6, 6), (8, 8)), max_colors=12)


@query()
def generate_mvp(spark, sf_dir):
    """The full baseline on all images: two canvases, three styles, landmarks; scored and ranked, with the image's status."""
    frames, pixels = _images(spark, sf_dir)
    marks = views.landmark(spark, sf_dir).withColumns({"x": F.col("x") % 4, "y": F.lit(2)})
    whole = frames.drop("tw", "th", "method")
    measures = generate.candidates(whole, pixels, views.palette(spark, sf_dir), _MVP, marks)[1]
    return generate.ranked(measures, _MVP, whole)


# Texts at the engine's borders.

TEXTS = """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN concat('https://host', CAST(doc_id AS VARCHAR(9)), '/mask/') WHEN 1 THEN 'ftp://host/x' WHEN 2 THEN 'http://user:pw@host/' WHEN 3 THEN 'http://host:8080' WHEN 4 THEN 'host/x' ELSE 'HTTPS://Host/a//' END AS endpoint,
 CASE doc_id % 5 WHEN 0 THEN 'a/b.png' WHEN 1 THEN '..' WHEN 2 THEN 'm\\b.png' ELSE concat('mask-', CAST(doc_id AS VARCHAR(9)), '.png') END AS file_name, CASE WHEN doc_id % 3 = 0 THEN '/data/x.png' ELSE 'img/x.png' END AS image_path,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 1000 / 1000e0 END AS share, doc_id * 37 % 60000 AS ms, concat('  bad ', chr(9), '  gateway ', chr(10), CAST(doc_id AS VARCHAR(9)), ' ') AS message FROM documents"""

_TENTH = "CAST(floor({v} * 10 + 0.5) / 10 AS DECIMAL(12, 1))"


@query(
    f"""SELECT id, CASE WHEN regexp_matches(endpoint, '^[hH][tT][tT][pP][sS]?://[^/@]+(/|$)') THEN regexp_replace(endpoint, '/$', '') END AS endpoint, file_name NOT IN ('.', '..', '') AND NOT contains(file_name, '/') AND NOT contains(file_name, '\\') AS safe,
 CASE WHEN starts_with(image_path, '/') THEN image_path ELSE '/set/' || image_path END AS path, coalesce(CAST({_TENTH.format(v='share * 100')} AS VARCHAR) || '%', 'n/a') AS percent, CAST({_TENTH.format(v='ms / 1000e0')} AS VARCHAR) || ' s' AS seconds,
 CASE WHEN coalesce(share >= 0.5, false) THEN 'PASS' ELSE 'FAIL' END AS verdict, trim(regexp_replace(message, '\\s+', ' ', 'g')) AS message FROM ({TEXTS})"""
)
def text_rules(spark, sf_dir):
    rows = spark.sql(TEXTS.replace("FROM documents", "FROM {documents}").replace("m\\b", "m\\\\b"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    c = F.col
    return rows.select(
        "id", scalars.endpoint(c("endpoint")).alias("endpoint"), scalars.safe_file_name(c("file_name")).alias("safe"), scalars.sample_path(F.lit("/set"), c("image_path")).alias("path"), scalars.percent(c("share")).alias("percent"),
        scalars.seconds(c("ms")).alias("seconds"), scalars.pass_fail(c("share") >= 0.5).alias("verdict"), scalars.bounded_message(c("message")).alias("message"),
    )
