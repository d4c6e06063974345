"""Colour arithmetic as Column expressions (sRGB 0..255, CIE L*a*b* under D65)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ (D65), row by row, and the white point by which X and Z are divided.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LUMINANCE = (0.2126, 0.7152, 0.0722)

#: Contrast, brightness, saturation; share of the colour limit; score bias.
STYLES = {
    "faithful": (1.0, 0.0, 1.0, 1.0, 0.015),
    "cute": (1.08, 12.0, 1.12, 0.9, 0.0),
    "simple": (1.02, 2.0, 0.92, 0.65, 0.01),
    "high-contrast": (1.24, 0.0, 1.08, 0.85, 0.005),
    "soft": (0.82, 10.0, 0.82, 0.8, 0.0),
}


def rounded(x: Column) -> Column:
    """Half-up rounding, also below zero."""
    return F.floor(x + 0.5)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def linear(channel: Column) -> Column:
    v = channel / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def pivot(t: Column) -> Column:
    d = 6.0 / 29.0
    return F.when(t > d**3, F.cbrt(t)).otherwise(t / (3 * d * d) + 4.0 / 29.0)


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct<l, a, b>."""
    channels = [linear(c) for c in (r, g, b)]
    fx, fy, fz = (pivot(sum(c * k for c, k in zip(channels, row, strict=True)) / w) for row, w in zip(XYZ, WHITE, strict=True))
    return F.struct((116 * fy - 16).alias("l"), (500 * (fx - fy)).alias("a"), (200 * (fy - fz)).alias("b"))


def delta_e76(x: Column, y: Column) -> Column:
    return F.sqrt(sum(F.pow(x[k] - y[k], F.lit(2.0)) for k in ("l", "a", "b")))


def hue_degrees(y: Column, x: Column) -> Column:
    h = F.degrees(F.atan2(y, x))
    return F.when(h < 0, h + 360.0).otherwise(h)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def delta_e2000(x: Column, y: Column) -> Column:
    """CIEDE2000 with unit weights, in stages that each evaluate what they share once."""
    length = lambda a, b: F.sqrt(a * a + b * b)
    cos = lambda d: F.cos(F.radians(d))
    high = lambda c: F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7))

    def scaled(p: Column) -> Column:
        g = 0.5 * (1 - high((length(p["x"]["a"], p["x"]["b"]) + length(p["y"]["a"], p["y"]["b"])) / 2))
        return F.struct(p["x"]["l"].alias("l1"), p["y"]["l"].alias("l2"), p["x"]["b"].alias("b1"), p["y"]["b"].alias("b2"), (p["x"]["a"] * (1 + g)).alias("a1"), (p["y"]["a"] * (1 + g)).alias("a2"))

    def polar(p: Column) -> Column:
        hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(hue_degrees(b, a))
        return F.struct(p["l1"].alias("l1"), p["l2"].alias("l2"), length(p["a1"], p["b1"]).alias("c1"), length(p["a2"], p["b2"]).alias("c2"), hue(p["a1"], p["b1"]).alias("h1"), hue(p["a2"], p["b2"]).alias("h2"))

    def means(p: Column) -> Column:
        gray, gap, total = p["c1"] * p["c2"] == 0, p["h2"] - p["h1"], p["h1"] + p["h2"]
        turn = F.when(gray, 0.0).when(F.abs(gap) <= 180, gap).when(gap > 0, gap - 360).otherwise(gap + 360)
        middle = F.when(gray, total).when(F.abs(gap) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
        return F.struct((p["l2"] - p["l1"]).alias("dl"), (p["c2"] - p["c1"]).alias("dc"), (2 * F.sqrt(p["c1"] * p["c2"]) * F.sin(F.radians(turn / 2))).alias("dh"), ((p["l1"] + p["l2"]) / 2).alias("l"), ((p["c1"] + p["c2"]) / 2).alias("c"), middle.alias("h"))

    def weighed(p: Column) -> Column:
        h, fifty = p["h"], (p["l"] - 50) * (p["l"] - 50)
        t = 1 - 0.17 * cos(h - 30) + 0.24 * cos(2 * h) + 0.32 * cos(3 * h + 6) - 0.2 * cos(4 * h - 63)
        turn = (h - 275) / 25
        rotation = -2 * high(p["c"]) * F.sin(F.radians(60 * F.exp(-turn * turn)))
        return F.struct((p["dl"] / (1 + 0.015 * fifty / F.sqrt(20 + fifty))).alias("l"), (p["dc"] / (1 + 0.045 * p["c"])).alias("c"), (p["dh"] / (1 + 0.015 * p["c"] * t)).alias("h"), rotation.alias("r"))

    staged = F.struct(x.alias("x"), y.alias("y"))
    for stage in (scaled, polar, means, weighed):
        staged = _let(staged, stage)
    return _let(staged, lambda p: F.sqrt(p["l"] * p["l"] + p["c"] * p["c"] + p["h"] * p["h"] + p["r"] * p["c"] * p["h"]))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * LUMINANCE[0] + g * LUMINANCE[1] + b * LUMINANCE[2]


def hue_bucket(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    chroma = (top - low).cast("double")
    wheel = F.pmod((g - b) / chroma + 6, F.lit(6.0))
    hue = F.when(top == r, wheel).when(top == g, (b - r) / chroma + 2).otherwise((r - g) / chroma + 4)
    return F.when(top - low < 22, "neutral").otherwise(F.concat(F.lit("hue-"), F.floor(hue).cast("string")))


def styled(r: Column, g: Column, b: Column, style: str) -> Column:
    """struct<r, g, b> of integers."""
    contrast, brightness, saturation, _, _ = STYLES[style]
    base = [clamped(rounded((c - 128) * contrast + 128 + brightness), 0, 255) for c in (r, g, b)]
    light = luminance(*base)
    return F.struct(*(clamped(rounded(light + (c - light) * saturation), 0, 255).cast("int").alias(n) for c, n in zip(base, "rgb", strict=True)))


def style_color_limit(most: int, style: str) -> int:
    return max(1, math.floor(most * STYLES[style][3] + 0.5))


def weighted_rgb_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(k * (x - y) * (x - y) for k, x, y in zip((0.3, 0.59, 0.11), a, b, strict=True)))


def composited(channel: Column, alpha: Column, background: Column) -> Column:
    """alpha in 0..255."""
    return rounded(channel * alpha / 255.0 + background * (1 - alpha / 255.0))


# Many colours at once, for kernels over Arrow batches

#: A matrix of distances is made so many at a time, so that its steps stay in a processor's cache.
AT_ONCE = 1 << 15


def lab_rows(rgb: np.ndarray) -> np.ndarray:
    """l, a, b of each row (r, g, b), as `lab` gives them."""
    v, d = rgb / 255.0, 6.0 / 29.0
    channels = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4).T
    around = [sum(c * k for c, k in zip(channels, row, strict=True)) / w for row, w in zip(XYZ, WHITE, strict=True)]
    fx, fy, fz = (np.where(t > d**3, np.cbrt(t), t / (3 * d * d) + 4.0 / 29.0) for t in around)
    return np.stack([116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)], axis=1)


def luminance_rows(rgb: np.ndarray) -> np.ndarray:
    return rgb[:, 0] * LUMINANCE[0] + rgb[:, 1] * LUMINANCE[1] + rgb[:, 2] * LUMINANCE[2]


def styled_rows(rgb: np.ndarray, style: str) -> np.ndarray:
    """`styled` of each row (r, g, b)."""
    contrast, brightness, saturation, _, _ = STYLES[style]
    base = np.clip(np.floor((rgb - 128) * contrast + 128 + brightness + 0.5), 0, 255)
    light = luminance_rows(base)[:, None]
    return np.clip(np.floor(light + (base - light) * saturation + 0.5), 0, 255).astype(np.int64)


def hue_rows(rgb: np.ndarray) -> np.ndarray:
    """The number of each row's `hue_bucket`, -1 for neutral ones."""
    r, g, b = rgb.T
    top, low = rgb.max(axis=1), rgb.min(axis=1)
    chroma = np.maximum(1, top - low).astype(np.float64)
    hue = np.where(top == r, ((g - b) / chroma + 6) % 6, np.where(top == g, (b - r) / chroma + 2, (r - g) / chroma + 4))
    return np.where(top - low < 22, -1, np.floor(hue)).astype(np.int64)


def e76_matrix(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distance of each row (l, a, b) of own to each of others."""
    return np.sqrt(((own[:, None] - others[None]) ** 2).sum(axis=2))


def e2000_matrix(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """CIEDE2000 with unit weights of each row (l, a, b) of own to each of others, as `delta_e2000` gives it."""
    out, step = np.empty((len(own), len(others))), max(1, AT_ONCE // max(1, len(others)))
    for a in range(0, len(own), step):
        out[a : a + step] = _e2000(*(own[a : a + step].T[:, :, None]), *(others.T[:, None, :]))
    return out


def e2000_rows(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """CIEDE2000 with unit weights of each row (l, a, b) of own to the same row of others."""
    return _e2000(*own.T, *others.T)


def _e2000(l1: np.ndarray, a1: np.ndarray, b1: np.ndarray, l2: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    length = lambda a, b: np.sqrt(a * a + b * b)

    def high(c: np.ndarray) -> np.ndarray:
        seventh = c * c
        seventh = seventh * seventh * seventh * c
        return np.sqrt(seventh / (seventh + 25.0**7))

    grow = 1.5 - 0.5 * high((length(a1, b1) + length(a2, b2)) / 2)
    a1, a2 = a1 * grow, a2 * grow
    c1, c2 = length(a1, b1), length(a2, b2)
    both = c1 * c2
    h1, h2 = (np.arctan2(b, a) for a, b in ((a1, b1), (a2, b2)))
    h1, h2 = (h + (h < 0) * (2 * np.pi) for h in (h1, h2))
    gray, gap, total = both == 0, h2 - h1, h1 + h2
    wide, over = np.abs(gap) > np.pi, total >= 2 * np.pi
    turn = np.where(wide, gap - np.copysign(2 * np.pi, gap), gap)
    h = np.where(wide, total / 2 + np.where(over, -np.pi, np.pi), total / 2)
    if gray.any():
        turn, h = np.where(gray, 0.0, turn), np.where(gray, total, h)
    c, fifty = (c1 + c2) / 2, ((l1 + l2) / 2 - 50) ** 2
    # Cosines of multiples of the hue from its own cosine and sine.
    x, y = np.cos(h), np.sin(h)
    x2, y2 = 2 * x * x - 1, 2 * x * y
    x3, y3 = x2 * x - y2 * y, y2 * x + x2 * y
    x4, y4 = 2 * x2 * x2 - 1, 2 * x2 * y2
    shift = lambda k, p, q, degrees: k * (math.cos(math.radians(degrees)) * p - math.sin(math.radians(degrees)) * q)
    t = 1 - shift(0.17, x, y, -30) + 0.24 * x2 + shift(0.32, x3, y3, 6) - shift(0.2, x4, y4, -63)
    bend = (h - math.radians(275)) / math.radians(25)
    rotation = -2 * high(c) * np.sin(math.radians(60) * np.exp(-bend * bend))
    dl, dc = (l2 - l1) / (1 + 0.015 * fifty / np.sqrt(20 + fifty)), (c2 - c1) / (1 + 0.045 * c)
    dh = 2 * np.sqrt(both) * np.sin(turn / 2) / (1 + 0.015 * c * t)
    return np.sqrt(np.maximum(dl * dl + dc * dc + dh * dh + rotation * dc * dh, 0))


#: By metric: the matrix of distances.
MATRICES = {"delta-e-76": e76_matrix, "delta-e-2000": e2000_matrix}
