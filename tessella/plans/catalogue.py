"""The registered queries over the derived views, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import color, scalars
from tessella.operators import editing, fusion, gate, kernels, planning, raster
from tessella.plans.registry import (
    ASSIGNED as _ASSIGNED,
    EVIDENCE as _EVIDENCE,
    INTERACTION as _INTERACTION,
    LANDMARK as _LANDMARK,
    LUM as _LUM,
    MASK as _MASK,
    NEAR as _NEAR,
    ORACLES,
    PALETTE as _PALETTE,
    PIXEL as _PIXEL,
    PREFERENCE as _PREFERENCE,
    QUERIES,
    e2000_ctes,
    lab_ctes as _lab,
    query as _query,
    r4,
    sql_r4 as _r4,
    with_ as _with,
)
from tessella.sources import views

# Colours


@_query(_with(_PIXEL, _lab("pixel", "labs")) + f"SELECT image_id, x, y, {_r4('l')} AS l, {_r4('la')} AS a, {_r4('lb')} AS b FROM labs")
def lab_convert(spark, sf_dir):
    lab = color.lab(*map(F.col, "rgb"))
    return views.pixel(spark, sf_dir).select("image_id", "x", "y", lab.alias("lab")).select("image_id", "x", "y", *(r4(F.col(f"lab.{k}")).alias(k) for k in ("l", "a", "b")))


@_query(_with(_PALETTE, _lab("palette", "labs")) + f"SELECT p.ord AS one, q.ord AS other, {_r4('sqrt(pow(p.l-q.l,2)+pow(p.la-q.la,2)+pow(p.lb-q.lb,2))')} AS distance FROM labs p JOIN labs q ON p.ord < q.ord")
def delta_e_76(spark, sf_dir):
    return _palette_pairs(spark, sf_dir, color.delta_e76)


def _palette_pairs(spark, sf_dir, distance):
    own = views.palette(spark, sf_dir).select("ord", color.lab(*map(F.col, "rgb")).alias("lab"))
    one, other = own.toDF("one", "p"), own.toDF("other", "q")
    return one.join(F.broadcast(other), F.col("one") < F.col("other")).select("one", "other", r4(distance(F.col("p"), F.col("q"))).alias("distance"))  # at most raster.MOST_COLORS rows


_HUE = lambda b, a: f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END)"
_E2000 = f"""e1 AS (SELECT p.ord AS one, q.ord AS other, p.l AS l1, p.la AS a1, p.lb AS b1, q.l AS l2, q.la AS a2, q.lb AS b2, (sqrt(p.la*p.la+p.lb*p.lb) + sqrt(q.la*q.la+q.lb*q.lb)) / 2 AS cm FROM labs p JOIN labs q ON p.ord < q.ord),
e2 AS (SELECT *, a1 * (1 + 0.5 * (1 - sqrt(pow(cm,7)/(pow(cm,7)+pow(25e0,7))))) AS ap1, a2 * (1 + 0.5 * (1 - sqrt(pow(cm,7)/(pow(cm,7)+pow(25e0,7))))) AS ap2 FROM e1),
e3 AS (SELECT *, sqrt(ap1*ap1+b1*b1) AS c1, sqrt(ap2*ap2+b2*b2) AS c2, {_HUE('b1', 'ap1')} AS h1, {_HUE('b2', 'ap2')} AS h2 FROM e2),
e4 AS (SELECT *, (l1+l2)/2 AS lm, (c1+c2)/2 AS cb, CASE WHEN c1*c2 = 0 THEN 0 WHEN abs(h2-h1) <= 180 THEN h2-h1 WHEN h2 > h1 THEN h2-h1-360 ELSE h2-h1+360 END AS dh,
 CASE WHEN c1*c2 = 0 THEN h1+h2 WHEN abs(h1-h2) <= 180 THEN (h1+h2)/2 WHEN h1+h2 < 360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS hm FROM e3),
e5 AS (SELECT *, 1 - 0.17*cos(radians(hm-30)) + 0.24*cos(radians(2*hm)) + 0.32*cos(radians(3*hm+6)) - 0.2*cos(radians(4*hm-63)) AS t,
 -2*sqrt(pow(cb,7)/(pow(cb,7)+pow(25e0,7)))*sin(radians(60*exp(-pow((hm-275)/25,2)))) AS rt FROM e4),
e6 AS (SELECT one, other, (l2-l1)/(1+0.015*pow(lm-50,2)/sqrt(20+pow(lm-50,2))) AS dl, (c2-c1)/(1+0.045*cb) AS dc, 2*sqrt(c1*c2)*sin(radians(dh/2))/(1+0.015*cb*t) AS dhh, rt FROM e5)"""


@_query(_with(_PALETTE, _lab("palette", "labs"), _E2000) + f"SELECT one, other, {_r4('sqrt(dl*dl+dc*dc+dhh*dhh+rt*dc*dhh)')} AS distance FROM e6")
def delta_e_2000(spark, sf_dir):
    return _palette_pairs(spark, sf_dir, color.delta_e2000)


def _style_sql() -> str:
    parts = []
    for name, (k, up, s, _, _) in color.STYLES.items():
        base = lambda c, k=k, up=up: f"greatest(0, least(255, floor(({c} - 128) * {k}e0 + 128 + {up}e0 + 0.5)))"
        lum = f"({base('r')} * 0.2126e0 + {base('g')} * 0.7152e0 + {base('b')} * 0.0722e0)"
        out = ", ".join(f"CAST(greatest(0, least(255, floor({lum} + ({base(c)} - {lum}) * {s}e0 + 0.5))) AS INT) AS {c}" for c in "rgb")
        parts.append(f"SELECT image_id, x, y, '{name}' AS style, {out} FROM pixel")
    return _with(_PIXEL) + " UNION ALL ".join(parts)


@_query(_style_sql())
def style_transform(spark, sf_dir):
    pixels = views.pixel(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("style"), color.styled(*map(F.col, "rgb"), s).alias("c")) for s in color.STYLES)))
    return pixels.select("image_id", "x", "y", each.alias("s")).select("image_id", "x", "y", "s.style", "s.c.*")


@_query(
    _with(_PIXEL)
    + f"""SELECT image_id, x, y, {_r4(_LUM)} AS luminance, CASE WHEN greatest(r,g,b) - least(r,g,b) < 22 THEN 'neutral' ELSE 'hue-' || CAST(CAST(floor(
 CASE WHEN greatest(r,g,b) = r THEN fmod((g - b) / CAST(greatest(r,g,b) - least(r,g,b) AS DOUBLE) + 6, 6e0) WHEN greatest(r,g,b) = g THEN (b - r) / CAST(greatest(r,g,b) - least(r,g,b) AS DOUBLE) + 2 ELSE (r - g) / CAST(greatest(r,g,b) - least(r,g,b) AS DOUBLE) + 4 END) AS BIGINT) AS VARCHAR) END AS hue FROM pixel"""
)
def luminance_hue_bucket(spark, sf_dir):
    rgb = [F.col(c) for c in "rgb"]
    return views.pixel(spark, sf_dir).select("image_id", "x", "y", r4(color.luminance(*rgb)).alias("luminance"), color.hue_bucket(*rgb).alias("hue"))


# Resampling


@_query(
    _with(_PIXEL)
    + """SELECT p.image_id, CAST(gx.i AS INT) AS x, CAST(gy.i AS INT) AS y, r, g, b FROM range(5) gx(i), range(5) gy(i) JOIN pixel p
 ON p.x = greatest(0, least(7, floor((gx.i + 0.5e0) * 8 / 5 - 0.5 + 0.5))) AND p.y = greatest(0, least(7, floor((gy.i + 0.5e0) * 8 / 5 - 0.5 + 0.5)))"""
)
def resize_nearest(spark, sf_dir):
    return raster.resize_nearest(views.pixel(spark, sf_dir), 8, 5, ["r", "g", "b"])


@_query(
    _with(
        _PIXEL,
        "axis AS (SELECT CAST(i AS INT) AS c, (i + 0.5e0) * 8 / 11 - 0.5 AS pos FROM range(11) t(i))",
        "taps AS (SELECT c, greatest(0, least(7, floor(pos))) AS p, 1 - (pos - floor(pos)) AS f FROM axis UNION ALL SELECT c, greatest(0, least(7, floor(pos) + 1)), pos - floor(pos) FROM axis)",
    )
    + f"SELECT image_id, tx.c AS x, ty.c AS y, {', '.join(_r4(f'sum(tx.f * ty.f * {c})') + f' AS {c}' for c in 'rgb')} FROM taps tx, taps ty JOIN pixel ON pixel.x = tx.p AND pixel.y = ty.p GROUP BY ALL"
)
def resize_bilinear(spark, sf_dir):
    return raster.resize_bilinear(views.pixel(spark, sf_dir), 8, 11, ["r", "g", "b"]).select("image_id", "x", "y", *(r4(F.col(c)).alias(c) for c in "rgb"))


_OVERLAP = "overlap AS (SELECT CAST(c AS INT) AS c, CAST(p AS INT) AS p, least((c + 1) * 8e0 / 3, p + 1) - greatest(c * 8e0 / 3, p) AS f FROM range(3) a(c), range(8) b(p) WHERE least((c + 1) * 8e0 / 3, p + 1) > greatest(c * 8e0 / 3, p))"


@_query(_with(_PIXEL, _OVERLAP) + f"SELECT image_id, ox.c AS x, oy.c AS y, {', '.join(_r4(f'sum(ox.f * oy.f * {c}) / sum(ox.f * oy.f)') + f' AS {c}' for c in 'rgb')} FROM pixel JOIN overlap ox ON pixel.x = ox.p JOIN overlap oy ON pixel.y = oy.p GROUP BY ALL")
def resize_area(spark, sf_dir):
    return raster.resize_area(views.pixel(spark, sf_dir), 8, 3, ["r", "g", "b"]).select("image_id", "x", "y", *(r4(F.col(c)).alias(c) for c in "rgb"))


@_query(
    _with(_PIXEL, f"lit AS (SELECT image_id, x, y, {_LUM} AS l FROM pixel)")
    + f"""SELECT image_id, x, y, {_r4("least(1, sqrt(pow(coalesce(lead(l) OVER r, l) - coalesce(lag(l) OVER r, l), 2) + pow(coalesce(lead(l) OVER c, l) - coalesce(lag(l) OVER c, l), 2)) / 255)")} AS edge FROM lit
 WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)"""
)
def edge_map(spark, sf_dir):
    return raster.edge_map(views.pixel(spark, sf_dir)).withColumn("edge", r4(F.col("edge")))


@_query(
    """SELECT w.w AS width, h.h AS height, CAST(floor((w.w - fw) / 2) AS BIGINT) AS x, CAST(floor((h.h - fh) / 2) AS BIGINT) AS y, CAST(fw AS BIGINT) AS fit_width, CAST(fh AS BIGINT) AS fit_height, CAST(n_nationkey AS BIGINT) AS id
 FROM nation, (VALUES (32), (48)) w(w), (VALUES (32), (40)) h(h), LATERAL (SELECT greatest(1, least(w.w, floor((n_nationkey + 5) * least(w.w / CAST(n_nationkey + 5 AS DOUBLE), h.h / 9e0) + 0.5))) AS fw,
 greatest(1, least(h.h, floor(9 * least(w.w / CAST(n_nationkey + 5 AS DOUBLE), h.h / 9e0) + 0.5))) AS fh) f"""
)
def fit_crop(spark, sf_dir):
    crops = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"))
    sizes = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")) for w in (32, 48) for h in (32, 40))))
    fit = scalars.fit_crop((F.col("id") + 5).cast("double"), F.lit(9.0), F.col("s.width"), F.col("s.height"))
    return crops.select("id", sizes.alias("s")).select("id", "s.*", fit.alias("f")).select("id", "width", "height", "f.x", "f.y", F.col("f.width").alias("fit_width"), F.col("f.height").alias("fit_height"))


# Colour assignment and grids


def _assigned(spark, sf_dir, metric="rgb"):
    return raster.assign_nearest(views.pixel(spark, sf_dir), raster.palette_rows(views.palette(spark, sf_dir)), metric)


@_query(_with(_PIXEL, _PALETTE, _ASSIGNED) + "SELECT * FROM assigned")
def assign_nearest_rgb(spark, sf_dir):
    return _assigned(spark, sf_dir)


@_query(
    _with(_PIXEL, _PALETTE, _lab("pixel", "pl"), _lab("palette", "cl"))
    + "SELECT image_id, x, y, ord FROM (SELECT p.image_id, p.x, p.y, c.ord, row_number() OVER (PARTITION BY p.image_id, p.x, p.y ORDER BY pow(p.l-c.l,2)+pow(p.la-c.la,2)+pow(p.lb-c.lb,2), c.ord) AS nth FROM pl p, cl c) WHERE nth = 1"
)
def assign_nearest_lab(spark, sf_dir):
    return _assigned(spark, sf_dir, "delta-e-76")


@_query(
    _with(_PIXEL, _PALETTE, _lab("pixel", "pl"), _lab("palette", "cl"), "pairs AS (SELECT p.image_id, p.x, p.y, c.ord, p.l AS l1, p.la AS a1, p.lb AS b1, c.l AS l2, c.la AS a2, c.lb AS b2 FROM pl p, cl c)", e2000_ctes("pairs", "d"))
    + "SELECT image_id, x, y, ord FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY distance, ord) AS nth FROM d) WHERE nth = 1"
)
def assign_nearest_2000(spark, sf_dir):
    return _assigned(spark, sf_dir, "delta-e-2000")


@_query(_with(_PIXEL, _PALETTE, _ASSIGNED) + "SELECT image_id, ord, count(*) AS n FROM assigned GROUP BY ALL")
def material_counts(spark, sf_dir):
    return raster.material_counts(_assigned(spark, sf_dir))


_MINIMUM = _with(
    _PIXEL, _PALETTE, _OVERLAP.replace("8e0 / 3", "8e0 / 4").replace("range(3)", "range(4)"),
    "cell AS (SELECT image_id, ox.c AS x, oy.c AS y, sum(ox.f*oy.f*r)/sum(ox.f*oy.f) AS r, sum(ox.f*oy.f*g)/sum(ox.f*oy.f) AS g, sum(ox.f*oy.f*b)/sum(ox.f*oy.f) AS b FROM pixel JOIN overlap ox ON pixel.x = ox.p JOIN overlap oy ON pixel.y = oy.p GROUP BY ALL)",
    "bytes AS (SELECT image_id, x, y, floor(r + 0.5) AS r, floor(g + 0.5) AS g, floor(b + 0.5) AS b FROM cell)", _lab("bytes", "pl"), _lab("palette", "cl"),
    "picked AS (SELECT p.image_id, c.ord, row_number() OVER (PARTITION BY p.image_id, p.x, p.y ORDER BY pow(p.l-c.l,2)+pow(p.la-c.la,2)+pow(p.lb-c.lb,2), c.ord) AS nth FROM pl p, cl c)",
)


@_query(_MINIMUM + "SELECT ord, count(*) AS cells, count(DISTINCT image_id) AS images FROM picked WHERE nth = 1 GROUP BY ord")
def pattern_materials(spark, sf_dir):
    """The flagship: images to 4 x 4 patterns in a palette, and the materials that they need."""
    cells = raster.resize_area(views.pixel(spark, sf_dir), 8, 4, ["r", "g", "b"]).select("image_id", "x", "y", *(color.rounded(F.col(c)).alias(c) for c in "rgb"))
    assigned = raster.assign_nearest(cells, raster.palette_rows(views.palette(spark, sf_dir)), "delta-e-76")
    return raster.material_counts(assigned).groupBy("ord").agg(F.sum("n").alias("cells"), F.count("*").alias("images"))


@_query(
    _with(_PIXEL, _PALETTE, _ASSIGNED, _lab("pixel", "pl"), "both0 AS (SELECT p.image_id, p.x, p.y, a.ord, p.l, p.la, p.lb FROM pl p JOIN assigned a USING (image_id, x, y))",
          "pairs AS (SELECT *, lead(ord) OVER r AS o1, lead(l) OVER r AS l1, lead(la) OVER r AS a1, lead(lb) OVER r AS b1, lead(ord) OVER c AS o2, lead(l) OVER c AS l2, lead(la) OVER c AS a2, lead(lb) OVER c AS b2 FROM both0 WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))",
          "votes AS (SELECT image_id, (sqrt(pow(l-l1,2)+pow(la-a1,2)+pow(lb-b1,2)) >= 12) = (ord <> o1) AS ok FROM pairs WHERE o1 IS NOT NULL UNION ALL SELECT image_id, (sqrt(pow(l-l2,2)+pow(la-a2,2)+pow(lb-b2,2)) >= 12) = (ord <> o2) FROM pairs WHERE o2 IS NOT NULL)")
    + f"SELECT image_id, {_r4('avg(CAST(ok AS INT))')} AS agreement FROM votes GROUP BY image_id"
)
def boundary_agreement(spark, sf_dir):
    return raster.boundary_agreement(views.pixel(spark, sf_dir), _assigned(spark, sf_dir)).withColumn("agreement", r4(F.col("agreement")))


_COLOR_PAIRS = "SELECT a.image_id, p.l AS l1, p.la AS a1, p.lb AS b1, c.l AS l2, c.la AS a2, c.lb AS b2"


@_query(
    _with(_PIXEL, _PALETTE, _ASSIGNED, _lab("pixel", "pl"), _lab("palette", "cl"), f"pairs AS ({_COLOR_PAIRS} FROM assigned a JOIN pl p USING (image_id, x, y) JOIN cl c USING (ord))", e2000_ctes("pairs", "d"))
    + f"SELECT image_id, {_r4('avg(distance)')} AS distance FROM d GROUP BY image_id"
)
def mean_color_distance(spark, sf_dir):
    out = raster.mean_color_distance(views.pixel(spark, sf_dir), _assigned(spark, sf_dir), views.palette(spark, sf_dir))
    return out.withColumn("distance", r4(F.col("distance")))


@_query(
    _with(_PIXEL, _PALETTE, _lab("pixel", "pl"), _lab("palette", "cl"), "d AS MATERIALIZED (SELECT p.image_id, p.x, p.y, c.ord, sqrt(pow(p.l-c.l,2)+pow(p.la-c.la,2)+pow(p.lb-c.lb,2)) AS d FROM pl p, cl c)",
          "one AS (SELECT image_id, ord FROM (SELECT image_id, ord, row_number() OVER (PARTITION BY image_id ORDER BY round(sum(d), 6), ord) AS nth FROM d GROUP BY image_id, ord) WHERE nth = 1)",
          "best AS (SELECT d.image_id, x, y, d AS b, one.ord AS first FROM d JOIN one USING (image_id, ord))",
          "two AS (SELECT image_id, ord, first FROM (SELECT d.image_id, d.ord, first, row_number() OVER (PARTITION BY d.image_id ORDER BY round(sum(least(d, b)), 6), d.ord) AS nth FROM d JOIN best USING (image_id, x, y) WHERE d.ord <> first GROUP BY d.image_id, d.ord, first) WHERE nth = 1)")
    + "SELECT image_id, least(first, ord) AS low, greatest(first, ord) AS high FROM two"
)
def palette_greedy(spark, sf_dir):
    out = raster.greedy_palette(views.pixel(spark, sf_dir), raster.palette_rows(views.palette(spark, sf_dir)), 2)
    return out.select("image_id", F.element_at("ords", 1).alias("low"), F.element_at("ords", 2).alias("high"))


def _select_sql(k: int) -> str:
    """Greedy choice of k colours by summed distance times weight, a round a CTE."""
    ctes = [_PIXEL, _PALETTE, _lab("pixel", "pl"), _lab("palette", "cl")]
    ctes.append("d AS MATERIALIZED (SELECT p.image_id, p.x, p.y, c.ord, sqrt(pow(p.l-c.l,2)+pow(p.la-c.la,2)+pow(p.lb-c.lb,2)) AS d, 1 + (p.x + p.y) % 3 AS w FROM pl p, cl c)")
    ctes.append("best0 AS (SELECT image_id, x, y, CAST('inf' AS DOUBLE) AS b FROM pl)")
    ctes.append("chosen0 AS (SELECT image_id, CAST([] AS INT[]) AS ords FROM pl GROUP BY image_id)")
    for i in range(k):
        ctes.append(
            f"pick{i} AS MATERIALIZED (SELECT image_id, ord FROM (SELECT image_id, ord, row_number() OVER (PARTITION BY image_id ORDER BY round(sum(least(d, b) * w), 6), ord) AS nth FROM d JOIN best{i} USING (image_id, x, y) JOIN chosen{i} USING (image_id) WHERE NOT list_contains(ords, ord) GROUP BY image_id, ord) WHERE nth = 1)"
        )
        ctes.append(f"chosen{i + 1} AS MATERIALIZED (SELECT image_id, list_append(ords, ord) AS ords FROM chosen{i} JOIN pick{i} USING (image_id))")
        ctes.append(f"best{i + 1} AS MATERIALIZED (SELECT image_id, x, y, least(b, d) AS b FROM best{i} JOIN pick{i} USING (image_id) JOIN d USING (image_id, x, y, ord))")
    return _with(*ctes) + f"SELECT image_id, array_to_string(list_sort(ords), ',') AS ords FROM chosen{k}"


@_query(_select_sql(8))
def palette_select(spark, sf_dir):
    """Eight of 24 colours for each image, its cells weighted."""
    weighted = views.pixel(spark, sf_dir).withColumn("weight", (1 + (F.col("x") + F.col("y")) % 3).cast("double"))
    out = raster.greedy_palette(weighted, raster.palette_rows(views.palette(spark, sf_dir)), 8)
    return out.select("image_id", F.array_join("ords", ",").alias("ords"))


@_query(_with(_PIXEL, _PALETTE, _ASSIGNED, _NEAR) + "SELECT image_id, count(*) FILTER (coalesce(l, -1) <> ord AND coalesce(rt, -1) <> ord AND coalesce(t, -1) <> ord AND coalesce(bt, -1) <> ord) AS n FROM near GROUP BY image_id")
def isolated_cells(spark, sf_dir):
    return raster.isolated_cells(_assigned(spark, sf_dir))


_INNER = "(l IS NOT NULL AND rt IS NOT NULL AND t IS NOT NULL AND bt IS NOT NULL)"


@_query(_with(_PIXEL, _PALETTE, _ASSIGNED, _NEAR) + f"SELECT image_id, count(*) FILTER ({_INNER} AND ((l = rt AND l <> ord) OR (t = bt AND t <> ord))) AS n FROM near GROUP BY image_id")
def thin_stripes(spark, sf_dir):
    return raster.thin_stripes(_assigned(spark, sf_dir))


@_query(
    _with(_PIXEL, _PALETTE, _ASSIGNED, _NEAR, f"s AS (SELECT *, CASE WHEN {_INNER} AND l = rt AND l <> ord THEN l END AS h, CASE WHEN {_INNER} AND t = bt AND t <> ord THEN t END AS v FROM near)")
    + "SELECT image_id, x, y, CASE WHEN h IS NULL AND v IS NULL THEN ord WHEN h IS NULL THEN v WHEN v IS NULL OR h = v THEN h ELSE ord END AS ord FROM s"
)
def cleanup_stripes(spark, sf_dir):
    return raster.cleaned_stripes(_assigned(spark, sf_dir))


@_query(
    _with(_PIXEL, _PALETTE, _ASSIGNED,
          "votes AS (SELECT a.image_id, a.x, a.y, a.ord, o.ord AS other, count(*) AS n, count(*) FILTER (abs(a.x-o.x)+abs(a.y-o.y) = 1) AS sides FROM assigned a JOIN assigned o ON a.image_id = o.image_id AND abs(a.x-o.x) <= 1 AND abs(a.y-o.y) <= 1 AND (a.x <> o.x OR a.y <> o.y) GROUP BY ALL)",
          "best AS (SELECT *, row_number() OVER w AS nth, sum(n) OVER p AS everyone, coalesce(sum(n) FILTER (other = ord) OVER p, 0) AS alike, coalesce(sum(sides) FILTER (other = ord) OVER p, 0) AS side FROM votes WINDOW w AS (PARTITION BY image_id, x, y ORDER BY n DESC, other), p AS (PARTITION BY image_id, x, y))")
    + "SELECT image_id, x, y, CASE WHEN everyone = 8 AND other <> ord AND n >= 6 AND side <= 1 AND n - alike > 1 THEN other ELSE ord END AS ord FROM best WHERE nth = 1"
)
def cleanup_alias(spark, sf_dir):
    return raster.cleaned_alias(_assigned(spark, sf_dir))


_HUES = """lit AS (SELECT *, greatest(r,g,b) AS top, CAST(greatest(r,g,b) - least(r,g,b) AS DOUBLE) AS ch, r * 0.2126e0 + g * 0.7152e0 + b * 0.0722e0 AS l FROM pixel),
hued AS (SELECT *, CASE WHEN ch < 22 THEN -1 WHEN top = r THEN floor(fmod((g - b) / ch + 6, 6e0)) WHEN top = g THEN floor((b - r) / ch + 2) ELSE floor((r - g) / ch + 4) END AS hue FROM lit),
groups AS (SELECT image_id, hue, list_sort(list(l)) AS s FROM hued GROUP BY ALL),
near AS (SELECT h.*, len(s) AS n, s[1] AS t0, s[CAST(floor((len(s) - 1) * 0.5e0 + 0.5) AS BIGINT) + 1] AS t1, s[len(s)] AS t2 FROM hued h JOIN groups USING (image_id, hue)),
moved AS (SELECT *, CASE WHEN n < 3 THEN 0 WHEN abs(t0 - l) <= abs(t1 - l) AND abs(t0 - l) <= abs(t2 - l) THEN t0 - l WHEN abs(t1 - l) <= abs(t2 - l) THEN t1 - l ELSE t2 - l END AS d FROM near)"""


@_query(_with(_PIXEL, _HUES) + "SELECT image_id, x, y, " + ", ".join(f"CAST(greatest(0, least(255, floor({c} + d + 0.5))) AS INT) AS {c}" for c in "rgb") + " FROM moved")
def value_levels(spark, sf_dir):
    return raster.value_levels(views.pixel(spark, sf_dir), 3)


# Masks


_MNEAR = "near AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS rt, lag(v) OVER c AS t, lead(v) OVER c AS bt FROM mask WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"


@_query(_with(_MASK, _MNEAR) + "SELECT image_id, x, y, v >= 0.5 AND NOT (coalesce(l, 0) >= 0.5 AND coalesce(rt, 0) >= 0.5 AND coalesce(t, 0) >= 0.5 AND coalesce(bt, 0) >= 0.5) AS boundary FROM near")
def mask_boundary(spark, sf_dir):
    return raster.mask_boundary(views.mask(spark, sf_dir))


@_query(_with(_MASK) + "SELECT a.image_id, a.x, a.y, max(CAST(o.v >= 0.5 AS INT)) AS \"on\" FROM mask a JOIN mask o ON a.image_id = o.image_id AND abs(a.x-o.x) <= 1 AND abs(a.y-o.y) <= 1 GROUP BY ALL")
def mask_dilate(spark, sf_dir):
    return raster.dilated(views.mask(spark, sf_dir))


@_query(
    _with(_MASK, _OVERLAP, "cover AS (SELECT image_id, ox.c AS x, oy.c AS y, sum(ox.f * oy.f * v) / sum(ox.f * oy.f) AS coverage FROM mask JOIN overlap ox ON mask.x = ox.p JOIN overlap oy ON mask.y = oy.p GROUP BY ALL)")
    + f"SELECT image_id, x, y, {_r4('coverage')} AS coverage, coverage >= 0.5 OR (NOT bool_or(coverage >= 0.5) OVER (PARTITION BY image_id) AND coverage > 0 AND row_number() OVER (PARTITION BY image_id ORDER BY coverage DESC, y, x) = 1) AS active FROM cover"
)
def coverage_raster(spark, sf_dir):
    return raster.coverage_raster(views.mask(spark, sf_dir), 8, 3).withColumn("coverage", r4(F.col("coverage")))


@_query(_with(_MASK) + f"SELECT a.image_id, {_r4('CASE WHEN sum(greatest(a.v, b.v)) > 0 THEN sum(least(a.v, b.v)) / sum(greatest(a.v, b.v)) ELSE 1 END')} AS iou FROM mask a JOIN mask b ON a.image_id = b.image_id AND a.x = b.y AND a.y = b.x GROUP BY ALL")
def coverage_iou(spark, sf_dir):
    one = views.mask(spark, sf_dir)
    return raster.coverage_iou(one, one.select("image_id", F.col("y").alias("x"), F.col("x").alias("y"), "v")).withColumn("iou", r4(F.col("iou")))


@_query(
    _with(_MASK, "box AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, min(x) FILTER (v >= 0.5) AS x0, max(x) FILTER (v >= 0.5) AS x1, min(y) FILTER (v >= 0.5) AS y0, max(y) FILTER (v >= 0.5) AS y1 FROM mask GROUP BY image_id)")
    + "SELECT image_id, CAST(greatest(0, x0 - 1) AS BIGINT) AS x, CAST(greatest(0, y0 - 1) AS BIGINT) AS y, CAST(least(w, x1 + 2) - greatest(0, x0 - 1) AS BIGINT) AS width, CAST(least(h, y1 + 2) - greatest(0, y0 - 1) AS BIGINT) AS height FROM box WHERE x0 IS NOT NULL"
)
def subject_bbox(spark, sf_dir):
    return raster.subject_box(views.mask(spark, sf_dir), padding=0.1)


@_query(_with(_MASK) + f"SELECT image_id, {_r4('CASE WHEN max(v) >= 0.5 THEN least(1, avg(abs(v - 0.5) * 2)) ELSE 0 END')} AS certainty FROM mask GROUP BY image_id")
def mask_certainty(spark, sf_dir):
    return raster.mask_certainty(views.mask(spark, sf_dir)).withColumn("certainty", r4(F.col("certainty")))


@_query(_with(_MASK, _MNEAR) + f"SELECT image_id, x, y, {_r4('least(1, v * 0.55 + greatest(0, coalesce(abs(v - l), 0), coalesce(abs(v - rt), 0), coalesce(abs(v - t), 0), coalesce(abs(v - bt), 0)) * 0.75)')} AS weight FROM near")
def boundary_importance(spark, sf_dir):
    return raster.boundary_importance(views.mask(spark, sf_dir)).withColumn("weight", r4(F.col("weight")))


@_query(
    _with(_MASK)
    + f"""SELECT a.image_id, a.x, a.y, {_r4("CASE WHEN a.v >= 0.5 THEN 1 ELSE -1 END * sqrt(min(pow(a.x-o.x, 2) + pow(a.y-o.y, 2)))")} AS distance FROM mask a LEFT JOIN mask o ON a.image_id = o.image_id AND (a.v >= 0.5) <> (o.v >= 0.5) GROUP BY a.image_id, a.x, a.y, a.v"""
)
def signed_distance(spark, sf_dir):
    return kernels.signed_distance(views.mask(spark, sf_dir)).withColumn("distance", r4(F.col("distance")))


_FAR = "far AS MATERIALIZED (SELECT a.image_id, a.x, a.y, CASE WHEN a.v >= 0.5 THEN 1 ELSE -1 END * sqrt(min(pow(a.x-o.x, 2) + pow(a.y-o.y, 2))) AS d FROM mask a LEFT JOIN mask o ON a.image_id = o.image_id AND (a.v >= 0.5) <> (o.v >= 0.5) GROUP BY a.image_id, a.x, a.y, a.v)"
_EDGE = "edge AS MATERIALIZED (SELECT image_id, x, y, v >= 0.5 AND NOT (coalesce(l, 0) >= 0.5 AND coalesce(rt, 0) >= 0.5 AND coalesce(t, 0) >= 0.5 AND coalesce(bt, 0) >= 0.5) AS b FROM near)"


@_query(
    _with(_MASK, _MNEAR, _FAR, _EDGE, "wide AS (SELECT a.image_id, a.x, a.y, bool_or(o.b) AS w FROM edge a JOIN edge o ON a.image_id = o.image_id AND abs(a.x-o.x) <= 1 AND abs(a.y-o.y) <= 1 GROUP BY ALL)",
          "both_ AS (SELECT image_id, e.b, w.w, coalesce(abs(f.d) <= 1.25, false) AS n, abs(f.d) AS d FROM edge e JOIN wide w USING (image_id, x, y) JOIN far f USING (image_id, x, y))")
    + f"SELECT image_id, {_r4('CASE WHEN count(*) FILTER (n OR w) > 0 THEN count(*) FILTER (n AND w) / CAST(count(*) FILTER (n OR w) AS DOUBLE) ELSE 1 END')} AS iou, {_r4('coalesce(least(1, avg(d) FILTER (b) / sqrt(128e0)), 0)')} AS distance FROM both_ GROUP BY image_id"
)
def boundary_iou(spark, sf_dir):
    one = views.mask(spark, sf_dir)
    out = raster.boundary_fit(one, kernels.signed_distance(one))
    return out.select("image_id", r4(F.col("iou")).alias("iou"), r4(F.col("distance")).alias("distance"))


_REACHED = """SELECT image_id, y * 8 + x AS root, x, y FROM {cells} UNION SELECT r.image_id, r.root, o.x, o.y FROM {name} r JOIN {cells} o ON o.image_id = r.image_id AND {near}"""


@_query(
    "WITH RECURSIVE "
    + ",\n".join([
        _MASK, "fore AS MATERIALIZED (SELECT image_id, x, y FROM mask WHERE v >= 0.5)", "back AS MATERIALIZED (SELECT image_id, x, y FROM mask WHERE v < 0.5)",
        f"reach AS ({_REACHED.format(cells='fore', name='reach', near='abs(o.x - r.x) + abs(o.y - r.y) = 1')})", f"gap AS ({_REACHED.format(cells='back', name='gap', near='abs(o.x - r.x) <= 1 AND abs(o.y - r.y) <= 1')})",
        "part AS (SELECT image_id, c, count(*) AS n FROM (SELECT image_id, x, y, min(root) AS c FROM reach GROUP BY ALL) GROUP BY ALL)",
        "hole AS (SELECT image_id, c FROM (SELECT image_id, x, y, min(root) AS c FROM gap GROUP BY ALL) GROUP BY ALL HAVING min(x) > 0 AND max(x) < 7 AND min(y) > 0 AND max(y) < 7)",
    ])
    + """
SELECT e.vec_id AS image_id, (SELECT count(*) FROM part p WHERE p.image_id = e.vec_id) AS components, coalesce((SELECT max(n) FROM part p WHERE p.image_id = e.vec_id), 0) AS largest, (SELECT count(*) FROM hole h WHERE h.image_id = e.vec_id) AS holes FROM embeddings e"""
)
def components_and_holes(spark, sf_dir):
    return kernels.topology(views.mask(spark, sf_dir))


@_query(
    _with(_MASK, _LANDMARK)
    + f"""SELECT m.image_id, m.x, m.y, {_r4("coalesce(max(greatest(0, 1 - sqrt(pow(m.x-k.x, 2) + pow(m.y-k.y, 2)) / 3) * k.confidence * CASE WHEN priority = 'hard' THEN 1 ELSE 0.75 END), 0)")} AS importance
 FROM mask m LEFT JOIN landmark k ON m.image_id = k.image_id AND abs(m.x - k.x) <= 2 AND abs(m.y - k.y) <= 2 GROUP BY ALL"""
)
def importance_map(spark, sf_dir):
    return raster.landmark_falloff(views.mask(spark, sf_dir), views.landmark(spark, sf_dir), 2).withColumn("importance", r4(F.col("importance")))


# Evaluation


_RESOLVED = "NOT initial_ok AND outcome = 'confirmed' AND coalesce(subject_ok, false)"
_MEASURES = f"""count(*) AS interactions, count(*) FILTER (NOT initial_ok) AS failures, count(*) FILTER ({_RESOLVED}) AS resolved, count(*) FILTER ({_RESOLVED} AND duration_ms <= 30000) AS quick,
 count(*) FILTER (cohort = 'clean-control') AS controls, count(*) FILTER (cohort = 'clean-control' AND initial_ok AND outcome = 'accepted') AS preserved, count(*) FILTER (device_class = 'mobile' AND input_modality IN ('touch', 'pen')) AS mobile,
 median(CAST(duration_ms AS DOUBLE)) FILTER ({_RESOLVED}) AS p50_ms, quantile_disc(CAST(duration_ms AS DOUBLE), 0.9) FILTER ({_RESOLVED}) AS p90_ms, median(CAST(stroke_count AS DOUBLE)) FILTER ({_RESOLVED}) AS median_strokes"""


@_query(_with(_INTERACTION) + f"SELECT * EXCLUDE (quick, preserved), {_r4('quick / nullif(failures, 0)')} AS within_30s, {_r4('preserved / nullif(controls, 0)')} AS control_preservation FROM (SELECT category, {_MEASURES} FROM interaction GROUP BY category)")
def gate_rates(spark, sf_dir):
    out = gate.measures(["category"], views.interaction(spark, sf_dir)).drop("accepted", "confirmed", "cancelled", "error", "quick", "preserved")
    return out.withColumn("within_30s", r4(F.col("within_30s"))).withColumn("control_preservation", r4(F.col("control_preservation")))


@_query(_with(_INTERACTION) + "SELECT key, count(image_id) AS n FROM (VALUES ('portrait'), ('pet'), ('illustration'), ('object'), ('none')) k(key) LEFT JOIN interaction ON category = key GROUP BY key")
def gate_counts(spark, sf_dir):
    return gate.counts_by(views.interaction(spark, sf_dir), "category", ["portrait", "pet", "illustration", "object", "none"])


_CENTER = "(p + {z}*{z}/(2*n)) / (1 + {z}*{z}/n)".format(z=scalars.Z95)
_RADIUS = "{z} * sqrt((p*(1-p) + {z}*{z}/(4*n)) / n) / (1 + {z}*{z}/n)".format(z=scalars.Z95)


@_query(_with(_INTERACTION, "c AS (SELECT cohort, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (initial_ok) / CAST(count(*) AS DOUBLE) AS p FROM interaction GROUP BY cohort)") + f"SELECT cohort, {_r4(f'greatest(0, {_CENTER} - {_RADIUS})')} AS lower, {_r4(f'least(1, {_CENTER} + {_RADIUS})')} AS upper FROM c")
def wilson(spark, sf_dir):
    counts = views.interaction(spark, sf_dir).groupBy("cohort").agg(F.count("*").alias("n"), F.sum(F.col("initial_ok").cast("int")).alias("k"))
    w = scalars.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return counts.select("cohort", r4(w["lower"]).alias("lower"), r4(w["upper"]).alias("upper"))


_GATE_TESTS = """interactions >= 40 AND (SELECT count(*) FILTER (category = 'portrait') >= 12 AND count(*) FILTER (category = 'pet') >= 12 AND count(*) FILTER (category = 'illustration') >= 8 AND count(*) FILTER (category = 'object') >= 8
 AND count(*) FILTER (cohort = 'targeted-failure') >= 32 AND count(*) FILTER (cohort = 'clean-control') >= 4 AND count(*) FILTER (cohort = 'extreme') >= 4 FROM interaction) AS sample_coverage,
 mobile >= 8 AND (SELECT count(*) FILTER (category = 'portrait') >= 2 AND count(*) FILTER (category = 'pet') >= 2 AND count(*) FILTER (category = 'illustration') >= 2 AND count(*) FILTER (category = 'object') >= 2 FROM interaction WHERE device_class = 'mobile' AND input_modality IN ('touch', 'pen')) AS mobile_coverage,
 failures >= 24 AS failure_coverage, (SELECT coalesce(bool_and(n >= 1), true) FROM (SELECT i.image_id, count(p.image_id) AS n FROM interaction i LEFT JOIN preference p USING (image_id) WHERE i.outcome = 'confirmed' GROUP BY 1)) AS preferences_cover,
 coalesce(quick / nullif(failures, 0) >= 0.8, false) AS quick_enough, coalesce(p50_ms <= 15000, false) AS p50_passes, coalesce(p90_ms <= 30000, false) AS p90_passes, coalesce(median_strokes <= 6, false) AS strokes_pass,
 coalesce((SELECT count(*) FILTER ((choice = 'left' AND left_variant = 'after') OR (choice = 'right' AND left_variant = 'before')) / nullif(count(*), 0) FROM preference) >= 0.75, false) AS after_passes, coalesce(preserved / nullif(controls, 0) >= 0.9, false) AS controls_pass"""
_QUICK = "(SELECT quick / CAST(failures AS DOUBLE) AS p, CAST(failures AS DOUBLE) AS n)"


@_query(
    _with(_INTERACTION, _PREFERENCE, f"m AS (SELECT {_MEASURES} FROM interaction)", f"t AS (SELECT *, (SELECT count(*) FROM preference) AS preferences, {_GATE_TESTS} FROM m)")
    + f"""SELECT t.*, {_r4(f'greatest(0, {_CENTER} - {_RADIUS})')} AS quick_low, {_r4(f'least(1, {_CENTER} + {_RADIUS})')} AS quick_high,
 sample_coverage AND mobile_coverage AND failure_coverage AND preferences_cover AND quick_enough AND p50_passes AND p90_passes AND strokes_pass AND after_passes AND controls_pass AS passed FROM t, LATERAL {_QUICK} q"""
)
def gate_summary(spark, sf_dir):
    out = gate.gate_summary(views.interaction(spark, sf_dir), views.preference(spark, sf_dir))
    return out.withColumn("quick_low", r4(F.col("quick_low"))).withColumn("quick_high", r4(F.col("quick_high")))


@_query(
    _with(_INTERACTION, _PREFERENCE)
    + "SELECT resolved, count(*) AS n FROM (SELECT CASE WHEN choice = 'tie' THEN 'tie' WHEN choice = 'left' THEN left_variant WHEN left_variant = 'before' THEN 'after' ELSE 'before' END AS resolved FROM preference) GROUP BY resolved"
)
def blind_resolve(spark, sf_dir):
    return gate.preferred(views.preference(spark, sf_dir)).groupBy("resolved").agg(F.count("*").alias("n"))


@_query("SELECT p_partkey AS image_id, row_number() OVER (ORDER BY sha256('seed:' || p_partkey), p_partkey) AS position FROM part")
def sample_order(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("image_id"))
    return gate.sample_order(part, "seed").withColumn("position", F.col("position").cast("long"))


@_query("SELECT p_partkey AS image_id, CASE WHEN CAST('0x' || substr(sha256('gate:' || p_partkey), 1, 2) AS INT) % 2 = 0 THEN 'before' ELSE 'after' END AS left_variant FROM part")
def blind_assignment(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("image_id"), gate.blind_left(F.concat(F.lit("gate:"), F.col("p_partkey").cast("string"))).alias("left_variant"))


@_query(
    _with(_INTERACTION, "manifest AS (SELECT p_partkey AS image_id FROM part)")
    + "SELECT *, missing = 0 AND unknown = 0 AS covered FROM (SELECT (SELECT count(*) FROM manifest WHERE image_id NOT IN (SELECT image_id FROM interaction)) AS missing, (SELECT count(*) FROM interaction WHERE image_id NOT IN (SELECT image_id FROM manifest)) AS unknown)"
)
def gate_manifest_coverage(spark, sf_dir):
    manifest = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("image_id"))
    return gate.manifest_coverage(views.interaction(spark, sf_dir).select("image_id"), manifest)


# Fusion and editing


@_query(_with(_EVIDENCE) + "SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY user_confirmed DESC, confidence DESC, source_priority DESC, evidence_id) AS nth FROM evidence) WHERE nth = 1")
def fuse_subject(spark, sf_dir):
    return fusion.subject(views.evidence(spark, sf_dir))


@_query(_with(_EVIDENCE) + "SELECT * EXCLUDE nth FROM (SELECT *, evidence_id % 3 AS region, row_number() OVER (PARTITION BY image_id, evidence_id % 3 ORDER BY confidence DESC, source_priority DESC, evidence_id) AS nth FROM evidence) WHERE nth = 1")
def fuse_by_id(spark, sf_dir):
    return fusion.best_by_id(views.evidence(spark, sf_dir).withColumn("region", F.col("evidence_id") % 3), ["image_id", "region"])


@_query(_with(_EVIDENCE) + "SELECT image_id, 'm' || source_priority AS name, string_agg(DISTINCT 'v' || CAST(floor(confidence * 10) AS INT), ' + ' ORDER BY 'v' || CAST(floor(confidence * 10) AS INT)) AS versions FROM evidence GROUP BY ALL")
def fuse_model_versions(spark, sf_dir):
    used = views.evidence(spark, sf_dir).select("image_id", F.concat(F.lit("m"), F.col("source_priority").cast("string")).alias("name"), F.concat(F.lit("v"), F.floor(F.col("confidence") * 10).cast("string")).alias("version"))
    return fusion.model_versions(used)


@_query("SELECT conv_id AS session, count(*) FILTER (role <> 'assistant') AS added, count(*) FILTER (role = 'assistant') AS erased, count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations) WHERE nth <= 2 GROUP BY conv_id")
def session_prefix_counts(spark, sf_dir):
    return editing.prefix_counts(views.stroke(spark, sf_dir), F.lit(2))


@_query(
    """WITH s AS (SELECT conv_id AS session, turn, CASE WHEN role = 'assistant' THEN 'erase' ELSE 'add' END AS mode, length(text) % 101 / 100e0 * 7 AS cx, length(text) * 7 % 101 / 100e0 * 7 AS cy FROM conversations),
b AS (SELECT session, turn, CAST(x AS INT) AS x, CAST(y AS INT) AS y, mode, 1 - sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) / 1.6e0 AS b FROM s, range(8) a(x), range(8) c(y) WHERE (x-cx)*(x-cx) + (y-cy)*(y-cy) <= 1.6e0*1.6e0),
l AS (SELECT session, x, y, list({'m': mode, 'b': b} ORDER BY turn) AS s FROM b GROUP BY ALL)
SELECT session, x, y, floor(list_reduce(s, lambda v, e: {'m': '', 'b': CASE WHEN e.m = 'add' THEN greatest(v.b, e.b) ELSE least(v.b, 1 - e.b) END}, {'m': '', 'b': 0e0}).b * 1e4 + 0.5) / 1e4 AS v FROM l"""
)
def paint_strokes(spark, sf_dir):
    return editing.painted(views.stroke(spark, sf_dir), 8).withColumn("v", r4(F.col("v")))


@_query(
    _with(_PIXEL, _PALETTE, _ASSIGNED, _NEAR, f"s AS (SELECT *, CASE WHEN {_INNER} AND l = rt AND l <> ord THEN l END AS h, CASE WHEN {_INNER} AND t = bt AND t <> ord THEN t END AS v FROM near)",
          "after AS (SELECT image_id, CASE WHEN h IS NULL AND v IS NULL THEN ord WHEN h IS NULL THEN v WHEN v IS NULL OR h = v THEN h ELSE ord END AS ord FROM s)")
    + "SELECT image_id, ord, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT image_id, ord, 1 AS d FROM after UNION ALL SELECT image_id, ord, -1 FROM assigned) GROUP BY ALL HAVING sum(d) <> 0"
)
def material_delta(spark, sf_dir):
    before = _assigned(spark, sf_dir)
    return editing.material_delta(raster.material_counts(before), raster.material_counts(raster.cleaned_stripes(before)))


@_query(_with(_MASK) + f"SELECT a.image_id, {_r4('avg(CAST(abs(a.v - b.v) >= 1 / 255e0 AS INT))')} AS share FROM mask a JOIN mask b ON a.image_id = b.image_id AND a.x = b.y AND a.y = b.x GROUP BY ALL")
def correction_area(spark, sf_dir):
    one = views.mask(spark, sf_dir)
    return editing.changed_share(one, one.select("image_id", F.col("y").alias("x"), F.col("x").alias("y"), "v")).withColumn("share", r4(F.col("share")))


@_query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 3 <> 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def jsonl_append_unique(spark, sf_dir):
    """One record for each key that the earlier batch doesn't hold."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    fresh = events.where("event_id % 3 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return fresh.join(events.where("event_id % 3 <> 0").select("user_id"), "user_id", "left_anti").select("event_id", "user_id")


# Planning


def _spread(spark, sf_dir):
    mask = views.mask(spark, sf_dir)
    on = F.when(F.col("v") >= 0.5, 1.0)
    return mask.groupBy("image_id").agg(F.coalesce(F.avg(F.coalesce(on, F.lit(0.0))), F.lit(0.0)).alias("share"), F.coalesce(F.avg(on * (F.col("x") + 0.5) / 8), F.lit(0.5)).alias("cx"), F.coalesce(F.avg(on * (F.col("y") + 0.5) / 8), F.lit(0.5)).alias("cy"))


_SPREAD = "spread AS (SELECT image_id, avg(CAST(v >= 0.5 AS INT)) AS share, coalesce(avg((x + 0.5e0) / 8) FILTER (v >= 0.5), 0.5) AS cx, coalesce(avg((y + 0.5e0) / 8) FILTER (v >= 0.5), 0.5) AS cy FROM mask GROUP BY image_id)"
_CANVAS = "canvas AS (SELECT image_id, size, size * size AS beads, greatest(0, least(1, 1 - abs(share - 0.55) / 0.55)) * 0.45 + 0.55 AS subject, greatest(0, least(1, 1 - sqrt(pow(cx - 0.5, 2) + pow(cy - 0.48, 2)) / 0.6)) AS composition, size * size / 9216e0 AS cost FROM spread, (VALUES (32), (48), (64)) s(size))"


@_query(_with(_MASK, _SPREAD, _CANVAS) + f"SELECT image_id, size, CAST(beads AS BIGINT) AS beads, {_r4('subject')} AS subject, {_r4('composition')} AS composition, {_r4('greatest(0, least(1, 0.38 + 0.18 * subject + 0.16 * composition + 0.28 - 0.3 * cost - 0.1 * sqrt(cost)))')} AS total FROM canvas")
def canvas_plans(spark, sf_dir):
    out = planning.canvas_plans(_spread(spark, sf_dir), [64, 32, 48, 32])
    return out.select("image_id", "size", "beads", *(r4(F.col(c)).alias(c) for c in ("subject", "composition", "total")))


@_query(_with(_LANDMARK) + f"SELECT image_id, 'eye-' || s AS landmark_id, size, CAST(least(4, greatest(1, floor(size * size / 1024e0 * 2 + 0.5))) AS BIGINT) AS allocated, true AS feasible, {_r4('''1.5 * CASE WHEN priority = 'hard' THEN 1.25 ELSE 1 END * confidence''')} AS weight FROM landmark, (VALUES (16), (32)) z(size)")
def feature_budgets(spark, sf_dir):
    sized = views.landmark(spark, sf_dir).withColumn("size", F.explode(F.array(F.lit(16), F.lit(32))))
    return planning.feature_budgets(sized, F.col("size")).select("image_id", "landmark_id", "size", "allocated", "feasible", r4(F.col("weight")).alias("weight"))


@_query(
    _with(_MASK, "three AS (SELECT m.label AS image_id, x, y, v, image_id % 3 AS ord, CASE image_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.9e0 ELSE 0.8e0 END AS confidence FROM mask m)")
    + "SELECT image_id, x, y, region FROM (SELECT image_id, x, y, ord AS region, row_number() OVER (PARTITION BY image_id, x, y ORDER BY v * confidence DESC, ord) AS nth FROM three WHERE v * confidence > 0.4) WHERE nth = 1"
)
def region_ids(spark, sf_dir):
    three = F.col("image_id") % 3
    regions = views.mask(spark, sf_dir).select(F.col("label").alias("image_id"), "x", "y", "v", three.alias("ord"), F.when(three == 0, 1.0).when(three == 1, 0.9).otherwise(0.8).alias("confidence"))
    return planning.region_ids(regions).withColumn("image_id", F.col("image_id").cast("int"))


@_query(
    _with(_MASK, _LANDMARK)
    + f"""SELECT m.image_id, m.x, m.y, {_r4("greatest(0.75 + 1.25 * m.v, coalesce(max(1 + CASE WHEN priority = 'hard' THEN 2 ELSE 1 END * k.confidence), 0))")} AS weight
 FROM mask m LEFT JOIN landmark k ON m.image_id = k.image_id AND abs(m.x - k.x) <= k.grid_radius AND abs(m.y - k.y) <= k.grid_radius GROUP BY m.image_id, m.x, m.y, m.v"""
)
def importance_weights(spark, sf_dir):
    out = planning.importance_weights(views.mask(spark, sf_dir).select("image_id", "x", "y", F.col("v").alias("importance")), views.landmark(spark, sf_dir))
    return out.withColumn("weight", r4(F.col("weight")))


def _score_sql() -> str:
    parts = []
    for style, (*_, bias) in color.STYLES.items():
        fw, cw = (0.24, 0.05) if style == "faithful" else (0.18, 0.11)
        total = f"(fid * {fw} + pf * 0.09 + structure * 0.22 + feature * 0.18 * conf + clean * 0.14 + craft * {cw} + canvas * 0.08) / (0.82 + 0.18 * conf) + {bias}"
        parts.append(f"SELECT image_id, valid, image_id || ':{style}' AS candidate_id, '{style}' AS style, greatest(0, least(1, {total})) AS total FROM m")
    return " UNION ALL ".join(parts)


_CANDIDATES = (
    """m0 AS (SELECT p_partkey AS image_id, p_partkey % 4 <> 0 AS valid, p_partkey % 50 / 1e0 AS src, p_partkey % 31 / 1e0 AS ref, p_partkey % 17 / 1e0 AS pl, p_partkey % 10 / 10e0 AS structure, p_partkey % 7 / 7e0 AS feature, p_partkey % 3 / 2e0 AS conf,
 p_partkey % 23 AS isolated, p_partkey % 29 AS stripes, 1024 AS cells, p_partkey % 24 AS colors, p_partkey % 5 / 5e0 AS canvas FROM part),
m AS (SELECT *, 1 / (1 + (0.35 * src + 0.65 * ref) / 15) AS fid, 1 / (1 + pl / 15) AS pf, greatest(0, least(1, 1 - (2 * isolated + stripes) / 1024e0)) AS clean, greatest(0, least(1, 1 - 0.25 * colors / 24e0 - isolated / 1024e0)) AS craft FROM m0),
c AS ("""
    + _score_sql()
    + ")"
)


@_query(_with(_CANDIDATES) + f"SELECT image_id, candidate_id, style, valid, CAST(nth AS INTEGER) AS nth, {_r4('total')} AS total FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY valid DESC, total DESC, candidate_id) AS nth FROM c) WHERE nth <= 3")
def candidate_rank(spark, sf_dir):
    k = F.col("p_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    measures = part.select(
        k.alias("image_id"), (k % 4 != 0).alias("valid"), (k % 50).cast("double").alias("source"), (k % 31).cast("double").alias("reference"), (k % 17).cast("double").alias("plan"), (k % 10 / 10).alias("structure"), (k % 7 / 7).alias("feature"),
        (k % 3 / 2).alias("confidence"), (k % 23).alias("isolated"), (k % 29).alias("stripes"), F.lit(1024).alias("cells"), (k % 24).alias("colors"), (k % 5 / 5).alias("canvas"),
    )
    return planning.ranked(planning.scored_styles(measures, 24), 3).select("image_id", "candidate_id", "style", "valid", "nth", r4(F.col("total")).alias("total"))


@_query(
    _with(_INTERACTION)
    + """SELECT 'known category' AS rule, count(*) FILTER (category NOT IN ('portrait', 'pet', 'illustration', 'object')) AS n FROM interaction UNION ALL SELECT 'rated if confirmed', count(*) FILTER (NOT coalesce(outcome <> 'confirmed' OR subject_ok IS NOT NULL, false)) FROM interaction
 UNION ALL SELECT 'quick', count(*) FILTER (NOT coalesce(duration_ms <= 5000, false)) FROM interaction"""
)
def validate_rules(spark, sf_dir):
    rules = {"known category": F.col("category").isin("portrait", "pet", "illustration", "object"), "rated if confirmed": (F.col("outcome") != "confirmed") | F.col("subject_ok").isNotNull(), "quick": F.col("duration_ms") <= 5000}
    return planning.violations(views.interaction(spark, sf_dir), rules)


@_query(_with(_EVIDENCE) + "SELECT * EXCLUDE nth FROM (SELECT *, CASE WHEN evidence_id % 4 = 0 THEN 'manual' ELSE 'automatic' END AS kind, row_number() OVER (PARTITION BY image_id ORDER BY evidence_id % 4 = 0 DESC, confidence DESC, evidence_id) AS nth FROM evidence) WHERE nth = 1")
def fuse_crop(spark, sf_dir):
    return fusion.crop(views.evidence(spark, sf_dir).withColumn("kind", F.when(F.col("evidence_id") % 4 == 0, "manual").otherwise("automatic")))


@_query("SELECT user_id, list_aggregate(list_sort(list_distinct(list(trim(event_type)) FILTER (trim(event_type) <> ''))), 'string_agg', ',') AS origins FROM events GROUP BY user_id")
def provenance_normalize(spark, sf_dir):
    origins = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.collect_set(F.concat(F.lit(" "), "event_type")).alias("o"))
    return origins.select("user_id", F.array_join(scalars.normalized_provenance(F.col("o")), ",").alias("origins"))


@_query(
    _with(
        _PIXEL, _MASK, _OVERLAP, f"lit AS (SELECT image_id, x, y, r, g, b, {_LUM} AS l FROM pixel)",
        "guided AS MATERIALIZED (SELECT lit.*, v AS importance, least(1, sqrt(pow(coalesce(lead(l) OVER w1, l) - coalesce(lag(l) OVER w1, l), 2) + pow(coalesce(lead(l) OVER w2, l) - coalesce(lag(l) OVER w2, l), 2)) / 255) AS edge FROM lit JOIN mask USING (image_id, x, y) WINDOW w1 AS (PARTITION BY image_id, lit.y ORDER BY lit.x), w2 AS (PARTITION BY image_id, lit.x ORDER BY lit.y))",
        "sent AS (SELECT image_id, ox.c AS gx, oy.c AS gy, x, y, r, g, b, importance, importance * 4 + edge * 1.25 AS s, ox.f * oy.f * (1 + importance * 4 + edge * 1.25) AS w FROM guided JOIN overlap ox ON guided.x = ox.p JOIN overlap oy ON guided.y = oy.p)",
        "sums AS (SELECT image_id, gx, gy, sum(w) AS w, avg(importance) AS mean, sum(w * r) AS r, sum(w * g) AS g, sum(w * b) AS b FROM sent GROUP BY ALL)",
        "peak AS (SELECT image_id, gx, gy, importance AS pi, r AS pr, g AS pg, b AS pb FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gx, gy ORDER BY s DESC, y, x) AS nth FROM sent) WHERE nth = 1)",
    )
    + "SELECT image_id, gx AS x, gy AS y, " + ", ".join(f"CAST(CASE WHEN pi >= 0.85 AND pi - mean >= 0.25 THEN p{c} ELSE floor({c} / w + 0.5) END AS INT) AS {c}" for c in "rgb") + " FROM sums JOIN peak USING (image_id, gx, gy)"
)
def resize_guided(spark, sf_dir):
    pixels = views.pixel(spark, sf_dir)
    guided = pixels.join(raster.edge_map(pixels), ["image_id", "x", "y"]).join(views.mask(spark, sf_dir).select("image_id", "x", "y", F.col("v").alias("importance")), ["image_id", "x", "y"])
    return raster.resize_guided(guided, 8, 3)


@_query(
    _with(_PIXEL, _PALETTE, _ASSIGNED, _lab("pixel", "pl"), _lab("palette", "cl"), "fine AS (SELECT gx // 3 AS x, gy // 3 AS y FROM range(24) a(gx), range(24) b(gy))",
          f"pairs AS ({_COLOR_PAIRS} FROM fine f JOIN assigned a USING (x, y) JOIN pl p ON p.image_id = a.image_id AND p.x = a.x AND p.y = a.y JOIN cl c USING (ord))", e2000_ctes("pairs", "d"))
    + f"SELECT image_id, {_r4('avg(distance)')} AS distance FROM d GROUP BY image_id"
)
def reference_metrics(spark, sf_dir):
    out = raster.reference_distance(views.pixel(spark, sf_dir), _assigned(spark, sf_dir), views.palette(spark, sf_dir), 8, 8, 24)
    return out.withColumn("distance", r4(F.col("distance")))


@_query(_with(_INTERACTION, f"m AS (SELECT device_class, {_MEASURES} FROM interaction GROUP BY device_class)") + "SELECT device_class, p50_ms, p90_ms, median_strokes FROM m")
def gate_percentiles(spark, sf_dir):
    return gate.measures(["device_class"], views.interaction(spark, sf_dir)).select("device_class", "p50_ms", "p90_ms", "median_strokes")


@_query(_with(_EVIDENCE) + f"SELECT image_id, {_r4('avg(confidence)')} AS confidence FROM evidence GROUP BY image_id")
def fuse_confidence(spark, sf_dir):
    return fusion.confidence(views.evidence(spark, sf_dir)).withColumn("confidence", r4(F.col("confidence")))


@_query()
def mask_contours(spark, sf_dir):
    return kernels.traced(views.mask(spark, sf_dir))


# Modules that register further queries.
from tessella.plans import attempts, checks, evidence, geometry, identity, outlines, revisions, sessions, smoothing  # noqa: E402, F401
