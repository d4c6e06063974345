"""Edits: brush strokes on masks, session prefixes, protocol replay, pattern adaptation bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a session that are folded or counted at a time.
TURNS = 4096

def brushed(strokes: DataFrame) -> DataFrame:
    """strokes (mode, radius, points) with cx, cy, r and step: where the brush touches on a mask of width x height.

    The brush goes from point to point in steps of at most half its radius (a quarter of a cell at least).
    """
    r = F.greatest(F.lit(0.5), F.col("radius") * F.least("width", "height"))
    spacing = F.greatest(F.lit(0.25), r * 0.5)
    place = lambda p: F.struct((p["x"] * (F.col("width") - 1)).alias("x"), (p["y"] * (F.col("height") - 1)).alias("y"))
    placed = strokes.withColumn("r", r).withColumn("at", F.transform("points", place))

    def path(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        n = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / spacing).cast("int"))
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct((a["x"] + dx * (k / n)).alias("x"), (a["y"] + dy * (k / n)).alias("y")))

    legs = F.flatten(F.transform(F.slice("at", 2, F.greatest(F.lit(0), F.size("at") - 1)), lambda b, i: path(F.get(F.col("at"), i), b)))
    touched = placed.select("*", F.posexplode(F.concat(F.slice("at", 1, 1), legs)).alias("step", "touch"))
    return touched.select(*strokes.columns, "r", "step", F.col("touch.x").alias("cx"), F.col("touch.y").alias("cy"))


def painted(strokes: DataFrame, side: int) -> DataFrame:
    """session, x, y, v: an empty mask of side x side after all strokes of one point, in order."""
    points = F.array(F.struct(F.col("px").alias("x"), F.col("py").alias("y")))
    return painted_over(strokes.select("session", "ord", "mode", "radius", points.alias("points"), F.lit(side).alias("width"), F.lit(side).alias("height")))


def painted_over(strokes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """session, x, y, v: masks after all strokes in order; base (session, x, y, v) gives them whole, else they start at 0 and touched cells come out.

    Every touch is sent to the cells of its disc. A brush is a clamp of the cell's value (add: maximum, erase: minimum),
    so each cell composes its brushes of every `TURNS` turns to one clamp, and applies these in order.
    """
    axis = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor(c - F.col("r")).cast("int")), F.least(F.col(n) - 1, F.ceil(c + F.col("r")).cast("int")))
    sent = brushed(strokes).select("*", F.explode(axis(F.col("cx"), "width")).alias("x")).select("*", F.explode(axis(F.col("cy"), "height")).alias("y"))
    square = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    brushes = sent.where(square <= F.col("r") * F.col("r")).select("session", "x", "y", F.struct("ord", "step", "mode", (1 - F.sqrt(square) / F.col("r")).alias("b")).alias("s"))
    clamp = lambda low, high: F.struct(low.alias("low"), high.alias("high"))  # noqa: E731 - the greatest of low and the least of a value and high
    fold = lambda c, s: F.when(s["mode"] == "add", clamp(F.greatest(c["low"], s["b"]), c["high"])).otherwise(clamp(F.least(c["low"], 1 - s["b"]), F.least(c["high"], 1 - s["b"])))
    few = brushes.groupBy("session", "x", "y", F.floor(F.col("s.ord") / TURNS).alias("turns")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    clamps = few.select("session", "x", "y", "turns", F.aggregate("s", clamp(F.lit(float("-inf")), F.lit(float("inf"))), fold).alias("c"))
    applied = lambda v, s: F.greatest(s["c"]["low"], F.least(v, s["c"]["high"]))
    cells = clamps.groupBy("session", "x", "y").agg(F.array_sort(F.collect_list(F.struct("turns", "c"))).alias("s"))
    if base is not None:
        cells = base.select("session", "x", "y", "v").join(cells, ["session", "x", "y"], "left")
    start = F.lit(0.0) if base is None else F.col("v")
    return cells.select("session", "x", "y", F.coalesce(F.aggregate("s", start, applied), start).alias("v"))


def replayed_sessions(operations: DataFrame, most: int = 512) -> DataFrame:
    """session, strokes (places of the strokes in the log, in order), cursor and dirty after all operations in order.

    append drops what was undone and adds a stroke; undo and redo move the cursor within the log. Dirty: not as `confirmed` says,
    the cursor at the last confirm (-1 before). A log has at most `most` strokes: later appends are refused and counted.
    """
    state = lambda strokes, cursor, mark, refused: F.struct(strokes.alias("strokes"), cursor.alias("cursor"), mark.alias("mark"), refused.alias("refused"))

    def step(s: Column, o: Column) -> Column:
        full = s["cursor"] >= most
        grown = F.concat(F.slice(s["strokes"], 1, s["cursor"]), F.array(o["ord"]))
        added = F.when(full, state(s["strokes"], s["cursor"], s["mark"], s["refused"] + 1)).otherwise(state(grown, s["cursor"] + 1, s["mark"], s["refused"]))
        back = state(s["strokes"], F.greatest(F.lit(0), s["cursor"] - 1), s["mark"], s["refused"])
        again = state(s["strokes"], F.least(F.size(s["strokes"]), s["cursor"] + 1), s["mark"], s["refused"])
        marked = state(s["strokes"], s["cursor"], F.slice(s["strokes"], 1, s["cursor"]), s["refused"])
        return F.when(o["op"] == "append", added).when(o["op"] == "undo", back).when(o["op"] == "redo", again).when(o["op"] == "confirm", marked).otherwise(s)

    empty = F.array().cast("array<long>")
    logs = operations.groupBy("session").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "op"))).alias("log"))
    end = F.aggregate("log", state(empty, F.lit(0), F.lit(None).cast("array<long>"), F.lit(0)), step)
    out = logs.select("session", end.alias("s"))
    active = F.slice("s.strokes", 1, F.col("s.cursor"))
    return out.select("session", "s.strokes", "s.cursor", active.alias("active"), (~active.eqNullSafe(F.col("s.mark"))).alias("dirty"), "s.refused")


def overlaid(before: DataFrame, after: DataFrame) -> DataFrame:
    """session, x, y, kind (added, erased, base or none), alpha of its colour, and byte (the mask in 0..255) of the cells of after."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    both = after.select("session", "x", "y", unit(F.col("v")).alias("q")).join(before.select("session", "x", "y", unit(F.col("v")).alias("p")), ["session", "x", "y"])
    added, base = F.col("q") - F.col("p"), F.col("p")
    kind = F.when(added > 0.01, "added").when(-added > 0.01, "erased").when(base > 0.01, "base").otherwise("none")
    alpha = F.when(added > 0.01, 168 * added).when(-added > 0.01, -168 * added).when(base > 0.01, 92 * base).otherwise(0.0)
    return both.select("session", "x", "y", kind.alias("kind"), F.floor(alpha + 0.5).cast("int").alias("alpha"), F.floor(F.col("q") * 255 + 0.5).cast("int").alias("byte"))


def changed_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """image_id, share of cells that differ by 1/255 or more."""
    both = before.select("image_id", "x", "y", F.col("v").alias("p")).join(after.select("image_id", "x", "y", F.col("v").alias("q")), ["image_id", "x", "y"])
    return both.groupBy("image_id").agg(F.avg((F.abs(F.col("p") - F.col("q")) >= 1 / 255).cast("double")).alias("share"))


def prefix_counts(strokes: DataFrame, cursor: Column) -> DataFrame:
    """session, added, erased, total among the first `cursor` strokes of each session."""
    counts = strokes.withColumn("cursor", cursor).groupBy("session", F.floor(F.col("ord") / TURNS).alias("turns"), "ord", "mode").agg(F.count("*").alias("n"), F.max("cursor").alias("cursor"))
    session, running = Window.partitionBy("session"), (Window.unboundedPreceding, -1)
    offsets = counts.groupBy("session", "turns").agg(F.sum("n").alias("n"), F.max("cursor").alias("cursor"))
    offsets = offsets.select(
        F.col("session").alias("of"), F.col("turns").alias("at"), F.coalesce(F.sum("n").over(session.orderBy("turns").rowsBetween(*running)), F.lit(0)).alias("before"), F.greatest(F.lit(0), F.max("cursor").over(session).cast("int")).alias("upto")
    )
    within = Window.partitionBy("session", "turns").orderBy("ord", "mode").rowsBetween(*running)
    placed = counts.select("session", "turns", "mode", "n", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("nth"))
    placed = placed.join(offsets, F.col("session").eqNullSafe(F.col("of")) & F.col("turns").eqNullSafe(F.col("at")))
    active = F.least(F.col("n"), F.greatest(F.lit(0), F.col("upto") - F.col("before") - F.col("nth")))
    of = lambda mode: F.sum(F.when(F.col("mode") == mode, active).otherwise(0)).alias("added" if mode == "add" else "erased")
    return placed.groupBy("session").agg(of("add"), of("erase"), F.sum(active).alias("total"))


def material_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """image_id, ord, delta: changed counts only."""
    a = before.select("image_id", "ord", F.col("n").alias("p"))
    b = after.select("image_id", "ord", F.col("n").alias("q"))
    delta = F.coalesce("q", F.lit(0)) - F.coalesce("p", F.lit(0))
    return a.join(b, ["image_id", "ord"], "full").select("image_id", "ord", delta.alias("delta")).where("delta <> 0")


def score(c: dict[str, Column], style: str, max_colors: int, bias: float) -> Column:
    """A candidate's total score. c: source, reference, plan, structure, feature, confidence, isolated, stripes, cells, colors, canvas."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    fidelity = 1 / (1 + (0.35 * c["source"] + 0.65 * c["reference"]) / 15)
    planned = 1 / (1 + c["plan"] / 15)
    cells = F.greatest(F.lit(1), c["cells"])
    clean = clamp(1 - (2 * c["isolated"] + c["stripes"]) / cells)
    craft = clamp(1 - 0.25 * c["colors"] / max(1, max_colors) - c["isolated"] / cells)
    first = style == "faithful"
    weighted = fidelity * (0.24 if first else 0.18) + planned * 0.09 + c["structure"] * 0.22 + c["feature"] * 0.18 * c["confidence"] + clean * 0.14 + craft * (0.05 if first else 0.11) + c["canvas"] * 0.08
    return clamp(weighted / (0.82 + 0.18 * c["confidence"]) + bias)
