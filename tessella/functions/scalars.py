"""Geometry, statistics and identity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.color import STYLES, clamped, rounded

Z95 = 1.959963984540054


def wilson(count: Column, total: Column, z: float = Z95) -> Column:
    """struct<lower, upper>: the Wilson score interval; null where total is 0."""
    p, zz = count / F.nullif(total, F.lit(0)), z * z
    scale = 1 + zz / total
    center = (p + zz / (2 * total)) / scale
    radius = z * F.sqrt((p * (1 - p) + zz / (4 * total)) / total) / scale
    some = total > 0
    return F.struct(F.when(some, F.greatest(F.lit(0.0), center - radius)).alias("lower"), F.when(some, F.least(F.lit(1.0), center + radius)).alias("upper"))


def rate(count: Column, total: Column) -> Column:
    return count / F.nullif(total, F.lit(0))


def fit_crop(crop_w: Column, crop_h: Column, width: Column, height: Column) -> Column:
    """struct<x, y, width, height>: the crop scaled to fit, centred."""
    scale = F.least(width / crop_w, height / crop_h)
    w = F.greatest(F.lit(1), F.least(width, rounded(crop_w * scale)))
    h = F.greatest(F.lit(1), F.least(height, rounded(crop_h * scale)))
    return F.struct(F.floor((width - w) / 2).alias("x"), F.floor((height - h) / 2).alias("y"), w.cast("long").alias("width"), h.cast("long").alias("height"))


def source_point(crop: Column, fit: Column, x: Column, y: Column) -> Column:
    """struct<x, y> of doubles, or null outside the fitted rectangle."""
    inside = (x >= fit["x"]) & (y >= fit["y"]) & (x < fit["x"] + fit["width"]) & (y < fit["y"] + fit["height"])
    sx = crop["x"] + (x - fit["x"] + 0.5) * crop["width"] / fit["width"] - 0.5
    sy = crop["y"] + (y - fit["y"] + 0.5) * crop["height"] / fit["height"] - 0.5
    return F.when(inside, F.struct(sx.alias("x"), sy.alias("y")))


def grid_cell(crop: Column, fit: Column, sx: Column, sy: Column) -> Column:
    """struct<x, y> of the clamped cell that a source point falls in."""
    gx = fit["x"] + F.floor((sx - crop["x"]) / crop["width"] * fit["width"])
    gy = fit["y"] + F.floor((sy - crop["y"]) / crop["height"] * fit["height"])
    return F.struct(F.greatest(fit["x"], F.least(fit["x"] + fit["width"] - 1, gx)).alias("x"), F.greatest(fit["y"], F.least(fit["y"] + fit["height"] - 1, gy)).alias("y"))


def whole_crop(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct<x, y, width, height>: a crop in whole pixels within its image, at least one pixel."""
    left, top = (F.greatest(F.lit(0), F.least(n - 1, F.floor(v))) for n, v in ((width, x), (height, y)))
    within = lambda v, rest: F.greatest(F.lit(1), F.least(rest, F.floor(v)))
    return F.struct(left.alias("x"), top.alias("y"), within(w, width - left).alias("width"), within(h, height - top).alias("height"))


def fractional_crop(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct<x, y, width, height>: a crop cut to its image, at least one pixel wide and high."""
    left, top = (F.greatest(F.lit(0.0), F.least(n - 1, v)) for n, v in ((width, x), (height, y)))
    right, bottom = (F.greatest(v + 1, F.least(n, end)) for v, n, end in ((left, width, x + w), (top, height, y + h)))
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"))


def resolved_crop(crop: Column, source: Column, confidence: Column) -> Column:
    """A suggested crop, if it counts: manual ones do, automatic ones from a confidence of 0.5, ones that say neither do."""
    automatic = (source == "automatic") | confidence.isNotNull()
    return F.when(source.eqNullSafe(F.lit("manual")) | ~F.coalesce(automatic, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) >= 0.5), crop)


def fitted_source(width: Column, height: Column, side: int = 2048, pixels: int = 4_000_000) -> Column:
    """struct<width, height, keeps_aspect>: source dimensions shrunk to the limits, and whether the aspect drifts by 1 % at most."""
    scale = F.least(F.lit(1.0), side / width, side / height, F.sqrt(pixels / (width * height)))
    w, h = (F.greatest(F.lit(1), rounded(n * scale)) for n in (width, height))
    return F.struct(w.alias("width"), h.alias("height"), (F.abs((w / h) / (width / height) - 1) <= 0.01).alias("keeps_aspect"))


def pointer_point(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """struct<x, y>: a pointer's place within a rectangle, 0..1."""
    return F.struct(clamped((x - left) / width, 0.0, 1.0).alias("x"), clamped((y - top) / height, 0.0, 1.0).alias("y"))


def device_class(width: Column) -> Column:
    return F.when(width <= 600, "mobile").when(width <= 900, "tablet").otherwise("desktop")


def modality(pointer: Column, touch_points: Column) -> Column:
    return F.when(pointer.isin("touch", "pen", "mouse"), pointer).when(touch_points > 0, "touch").otherwise("mouse")


def landmark_radius(grid_radius: Column, source_radius: Column, scale: Column) -> Column:
    """A landmark's radius in cells: its own, else its source radius scaled, else 0."""
    scaled = F.greatest(F.lit(0), rounded(F.greatest(F.lit(0.0), source_radius) * scale))
    return F.when(grid_radius.isNotNull(), F.greatest(F.lit(0), rounded(grid_radius))).when(source_radius.isNotNull(), scaled).otherwise(0).cast("long")


def anchor_cells(priority: Column, radius: Column) -> Column:
    """Cells that a landmark needs at least: none if soft, else a row across its disc."""
    whole = F.greatest(F.lit(0), F.floor(F.coalesce(radius, F.lit(0))))
    return F.when(priority == "soft", 0).otherwise(F.greatest(F.lit(1), 2 * whole + 1)).cast("long")


def style_limit(most: Column, style: Column) -> Column:
    """The colours that a style may use."""
    share = F.create_map(*(F.lit(x) for name, v in STYLES.items() for x in (name, v[3])))[style]
    return F.greatest(F.lit(1), rounded(most * share)).cast("long")


def disk_cells(radius: Column) -> Column:
    """Lattice points within radius + 1/4, at least one."""
    r = F.ceil(radius).cast("int")
    axis = F.sequence(-r, r)
    points = F.flatten(F.transform(axis, lambda dx: F.transform(axis, lambda dy: F.sqrt((dx * dx + dy * dy).cast("double")))))
    return F.greatest(F.lit(1), F.size(F.filter(points, lambda d: d <= radius + 0.25)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code units of an ASCII text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))


def normalized_provenance(entries: Column) -> Column:
    """Distinct, trimmed, non-empty strings in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(entries, lambda e: F.trim(e)), lambda e: e.isNotNull() & (e != ""))))


def bounded_message(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, "\\s+", " ")), 1, 500)


def contain_rect(source_w: Column, source_h: Column, box_w: Column, box_h: Column) -> Column:
    """struct<x, y, width, height, scale>: a letterboxed rectangle."""
    scale = F.least(box_w / source_w, box_h / source_h)
    return F.struct(((box_w - source_w * scale) / 2).alias("x"), ((box_h - source_h * scale) / 2).alias("y"), (source_w * scale).alias("width"), (source_h * scale).alias("height"), scale.alias("scale"))


def mask_byte(v: Column) -> Column:
    return rounded(clamped(v, 0.0, 1.0) * 255).cast("int")


# Texts at the engine's borders


def endpoint(url: Column) -> Column:
    """An http or https address without credentials and trailing slash, else null."""
    return F.when(url.rlike("^[hH][tT][tT][pP][sS]?://[^/@]+(/|$)"), F.regexp_replace(url, "/$", ""))


def safe_file_name(name: Column) -> Column:
    """Whether a name stays in its folder."""
    return ~name.isin("", ".", "..") & ~name.contains("/") & ~name.contains("\\")


def sample_path(folder: Column, path: Column) -> Column:
    """An absolute path, or one beside the manifest."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))


def _tenths(v: Column) -> Column:
    return (F.floor(v * 10 + 0.5) / 10).cast("decimal(12,1)").cast("string")


def percent(share: Column) -> Column:
    return F.coalesce(F.concat(_tenths(share * 100), F.lit("%")), F.lit("n/a"))


def seconds(ms: Column) -> Column:
    return F.coalesce(F.concat(_tenths(ms / 1000), F.lit(" s")), F.lit("n/a"))


def pass_fail(holds: Column) -> Column:
    return F.when(holds, "PASS").otherwise("FAIL")
