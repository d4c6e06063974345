"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token mass is summed by cell (source, language, topic). The goals of a dimension are kept masses: its targets' shares of
`budget` times the whole mass. A value whose goal is more than all it has is limited to that (and named in the
`mixture_report`), and the rest of its goal goes to the other values in proportion. Raking then scales the
cells' kept masses to each dimension's goals in turn; no cell is scaled beyond its mass, and what it can't give the other
cells of the value give. Sweeps go on until no marginal is further from its goal than `TOLERANCE` of the whole, `MOST_SWEEPS`
at most. A document is kept with probability kept mass / mass of its cell. The coin is a hash of the id, so a run can
be repeated and lost tasks recomputed.

Targets are given by dimension as tables (value, share); a value without a target gets none, and a dimension without a
table gets its present shares to the power `temperature`: below 1 this lifts small values and holds back large ones. The topic is a
column of the documents; without one `topic_of` tells the form of a text. Built-in functions only.

Few cells (`FEW_CELLS`, checked) are one partition, in which sweeps need no shuffle, and are broadcast to the documents; more of
them are summed by value with partial aggregates and joined by shuffles.

Shares of a table needn't sum to 1; those of a repeated value are summed. A null value stands for "(null)". A share that is null, negative
or not finite, a dimension that doesn't exist, and a table none of whose values has both a share above 0 and documents raise an error.
A value that no document has gets nothing; `mixture_report` lists it as limited.

Defined results. Null source, language or topic: a value of its own, written "(null)". Null text: one token, topic
"empty". Repeated rows share their fate, as all rows of an id do; rows with a null id share one coin.
Empty table: no rows. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import durable, fresh

DIMENSIONS = ("source", "lang", "topic")
BUDGET, TEMPERATURE, SEED = 0.8, 0.7, "mix"
#: Rounds in which goals beyond what there is are limited; sweeps between two checks, and in all; the deviation that ends them.
LIMIT_ROUNDS, CHUNK, MOST_SWEEPS, TOLERANCE = 8, 4, 60, 5e-4
#: Cells up to this number (some 100 bytes each) are one partition and are broadcast.
FEW_CELLS = 50_000


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a quarter of the bytes, rounded down, plus one."""
    return (F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / 4) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """The form of a text: table, numeric, or prose of three lengths."""
    size = F.length(text)
    bars = size - F.length(F.replace(text, F.lit("|"), F.lit("")))
    digits = size - F.length(F.translate(text, "0123456789", ""))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(bars * 50 >= size, "table")
        .when(digits * 10 >= size, "numeric")
        .when(size < 500, "note")
        .when(size < 5000, "article")
        .otherwise("long")
    )


def described(docs: DataFrame, topic: str | None = None) -> Column:
    """source, lang, topic and tokens of each row of docs, as one struct."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(null)"))
    text = F.col("text").cast("string")
    return F.struct(name("source").alias("source"), name("lang").alias("lang"), (topic_of(text) if topic is None else name(topic)).alias("topic"), tokens_of(text).alias("tokens"))


def target_shares(dimension: str, table: DataFrame) -> DataFrame:
    """dimension, value and given: the table's shares, summed by value. A share that isn't a finite number of at least 0 fails the query."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"no dimension {dimension!r}; there are {', '.join(DIMENSIONS)}")
    share = F.col("share").cast("double")
    sound = share.isNotNull() & ~F.isnan(share) & (share >= 0) & (share < float("inf"))
    wrong = F.raise_error(F.concat(F.lit(f"a share of {dimension} isn't a finite number of at least 0: "), F.coalesce(F.col("share").cast("string"), F.lit("null"))))
    value = F.coalesce(F.col("value").cast("string"), F.lit("(null)"))
    return table.select(F.lit(dimension).alias("dimension"), value.alias("value"), F.when(sound, share).otherwise(wrong.cast("double")).alias("given")).groupBy("dimension", "value").agg(F.sum("given").alias("given"))


def limited_goals(marginals: DataFrame, kept: float) -> DataFrame:
    """dimension, value, mass, share (not normalised) with goal: shares of kept, none above its mass."""
    sums = marginals.groupBy("dimension").agg(F.sum("share")).collect()  # a row for each dimension
    if kept and (lost := sorted(d for d, r in sums if not r)):
        raise ValueError(f"no document has a value with a target above 0: {', '.join(lost)}")
    scale = {d: (kept / r if r else 0.0) for d, r in sums}
    for _ in range(LIMIT_ROUNDS):
        of_dimension = F.element_at(F.create_map(*(F.lit(x) for pair in scale.items() for x in pair)), F.col("dimension")) if scale else F.lit(0.0)
        wanted = F.col("share") * of_dimension
        sums = marginals.groupBy("dimension").agg(F.sum(F.when(wanted >= F.col("mass"), F.col("mass"))).alias("full"), F.sum(F.when(wanted < F.col("mass"), F.col("share"))).alias("open"))
        now = {r.dimension: ((kept - (r.full or 0.0)) / r.open if r.open else scale[r.dimension]) for r in sums.collect()}
        if now == scale:
            break
        scale = now
    of_dimension = F.element_at(F.create_map(*(F.lit(x) for pair in scale.items() for x in pair)), F.col("dimension")) if scale else F.lit(0.0)
    return marginals.withColumn("goal", F.least("mass", F.col("share") * of_dimension))


def _factor(total: Column, full: Column, goal: Column) -> Column:
    """What scales kept masses of a value: up, the cells that aren't full; down, all."""
    up = F.when(total > full, (goal - full) / (total - full)).otherwise(1.0)
    return F.when(total < goal, up).when(total > 0, goal / total).otherwise(1.0)


def _swept(cells: DataFrame, few: bool) -> DataFrame:
    """cells after scaling kept to each dimension's goals in turn."""
    full = F.when(F.col("kept") >= F.col("mass"), F.col("mass")).otherwise(0.0)
    for d in DIMENSIONS:
        if few:
            value = Window.partitionBy(d)
            summed = cells.withColumns({"total": F.sum("kept").over(value), "full": F.sum(full).over(value)})
        else:
            sums = durable(cells.groupBy(d).agg(F.sum("kept").alias("total"), F.sum(full).alias("full")))
            summed = cells.join(sums, d)
        factor = _factor(F.col("total"), F.col("full"), F.col(f"goal_{d}"))
        stays = (F.col("kept") >= F.col("mass")) & (F.col("total") < F.col(f"goal_{d}"))
        cells = summed.withColumn("kept", F.when(stays, F.col("mass")).otherwise(F.least("mass", F.col("kept") * factor))).drop("total", "full")
        cells = cells if few else durable(cells)
    return cells


def _marginals(cells: DataFrame, mass: str = "mass") -> DataFrame:
    values = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(mass).cast("double").alias(mass)) for d in DIMENSIONS))
    return cells.select(F.inline(values)).groupBy("dimension", "value").agg(F.sum(mass).alias(mass))


def raked_cells(cells: DataFrame, budget: float = BUDGET, temperature: float = TEMPERATURE, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells (source, lang, topic, mass) with each dimension's goal and kept: masses raked to the goals."""
    cells = durable(cells.select(*DIMENSIONS, F.col("mass").cast("double").alias("mass")))
    sums = cells.agg(F.count("*").alias("n"), F.sum("mass").alias("mass")).first()
    few, kept = sums["n"] <= FEW_CELLS, budget * (sums["mass"] or 0.0)
    one = lambda df: df.coalesce(1) if few else df  # noqa: E731 - then every group and window finds its rows in place
    cells = one(cells)
    marginals = _marginals(cells).withColumn("share", F.pow("mass", F.lit(float(temperature))))
    for d, table in (targets or {}).items():
        marginals = marginals.join(target_shares(d, table), ["dimension", "value"], "left").withColumn("share", F.when(F.col("dimension") == d, F.coalesce("given", F.lit(0.0))).otherwise(F.col("share"))).drop("given")
    goals = one(durable(limited_goals(one(durable(marginals)), kept)))
    for d in DIMENSIONS:
        cells = cells.join(goals.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("goal").alias(f"goal_{d}")), d)
    fit = one(durable(cells.withColumn("kept", F.col("mass") * budget)))
    for _ in range(0, MOST_SWEEPS, CHUNK):
        for _ in range(CHUNK):
            fit = _swept(fit, few)
        fit = one(durable(fit))
        off = _marginals(fit, "kept").join(goals, ["dimension", "value"]).agg(F.max(F.abs(F.col("kept") - F.col("goal")))).first()[0]
        if off is None or off <= TOLERANCE * kept:
            break
    return fit


def _cells(described_rows: DataFrame) -> DataFrame:
    return described_rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("mass"))


def _with_fate(rows: DataFrame, of: dict[str, Column], cells: DataFrame, seed: str, names: list[str]) -> DataFrame:
    """rows with the probability of their cell and whether they are kept, under two new names."""
    probability, kept, key = names
    fate = cells.select(F.struct(*DIMENSIONS).alias(key), (F.col("kept") / F.col("mass")).alias(probability))
    few = cells.count() <= FEW_CELLS
    coin = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    keyed = rows.withColumn(key, F.struct(*(of[d].alias(d) for d in DIMENSIONS)))
    return keyed.join(F.broadcast(fate) if few else fate, key).drop(key).withColumn(kept, coin < F.col(probability))


def mixing_report(docs: DataFrame, budget: float = BUDGET, temperature: float = TEMPERATURE, targets: dict[str, DataFrame] | None = None, seed: str = SEED, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability (6 digits) and kept for each row."""
    rows = durable(docs.select("doc_id", described(docs, topic).alias("own")).select("doc_id", "own.*"))
    cells = raked_cells(_cells(rows), budget, temperature, targets)
    out = _with_fate(rows, {d: F.col(d) for d in DIMENSIONS}, cells, seed, ["probability", "kept", "cell"])
    return out.select("doc_id", *DIMENSIONS, "tokens", F.round("probability", 6).alias("probability"), "kept")


def sample_mixture(docs: DataFrame, budget: float = BUDGET, temperature: float = TEMPERATURE, targets: dict[str, DataFrame] | None = None, seed: str = SEED, topic: str | None = None) -> DataFrame:
    """The rows of docs that the mixture keeps."""
    own, *names = fresh(docs, "own_cell", "own_probability", "own_fate", "own_key")
    cells = raked_cells(_cells(docs.select(described(docs, topic).alias("own")).select("own.*")), budget, temperature, targets)
    rows = docs.select("*", described(docs, topic).alias(own))
    out = _with_fate(rows, {d: F.col(f"{own}.{d}") for d in DIMENSIONS}, cells, seed, names)
    return out.where(F.col(names[1])).select(*(F.col(f"`{c}`") for c in docs.columns))


def mixture_report(docs: DataFrame, budget: float = BUDGET, temperature: float = TEMPERATURE, targets: dict[str, DataFrame] | None = None, topic: str | None = None) -> DataFrame:
    """dimension, value, available (share of all tokens), goal and expected (shares of the kept ones), limited and met (within 0.01).

    Limited: the value has no more than its goal, or nothing at all (available 0). A goal that isn't met contradicts those of the other dimensions.
    """
    cells = raked_cells(_cells(docs.select(described(docs, topic).alias("own")).select("own.*")), budget, temperature, targets)
    values = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col("mass"), F.col("kept"), F.col(f"goal_{d}").alias("goal")) for d in DIMENSIONS))
    sums = cells.select(F.inline(values)).groupBy("dimension", "value").agg(F.sum("mass").alias("mass"), F.sum("kept").alias("kept"), F.max("goal").alias("goal"))
    whole = cells.agg(F.sum("mass").alias("all_mass"), F.sum("kept").alias("all_kept"))
    out = sums.join(F.broadcast(whole)).select(  # one row
        "dimension", "value", (F.col("mass") / F.col("all_mass")).alias("available"), (F.col("goal") / (budget * F.col("all_mass"))).alias("goal"),
        (F.col("kept") / F.col("all_kept")).alias("expected"), (F.col("goal") >= F.col("mass")).alias("limited"),
    )
    for d, table in (targets or {}).items():  # targets of values that no document has
        given = target_shares(d, table).where("given > 0")
        whole_given = given.agg(F.sum("given").alias("all_given"))
        absent = given.join(F.broadcast(whole_given)).join(sums.select("dimension", "value"), ["dimension", "value"], "left_anti")
        none = F.lit(0.0)
        out = out.unionByName(absent.select("dimension", "value", none.alias("available"), (F.col("given") / F.col("all_given")).alias("goal"), none.alias("expected"), F.lit(True).alias("limited")))
    return out.withColumn("met", F.abs(F.col("expected") - F.col("goal")) <= 0.01)


def mixing_sql(budget: float = BUDGET, temperature: float = TEMPERATURE, seed: str = SEED, documents: str = "documents") -> str:
    """DuckDB SQL for `mixing_report` without targets."""
    ctes = [
        f"""own AS MATERIALIZED (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
  CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty'
       WHEN (length(text) - length(replace(text, '|', ''))) * 50 >= length(text) THEN 'table'
       WHEN (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) * 10 >= length(text) THEN 'numeric'
       WHEN length(text) < 500 THEN 'note' WHEN length(text) < 5000 THEN 'article' ELSE 'long' END AS topic,
  CAST(coalesce(strlen(text), 0) // 4 + 1 AS BIGINT) AS tokens FROM {documents})""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS mass FROM own GROUP BY ALL)",
        f"whole AS MATERIALIZED (SELECT CAST({budget} AS DOUBLE) * sum(mass) AS target FROM cells)",
    ]
    for d in DIMENSIONS:
        ctes.append(f"m_{d} AS MATERIALIZED (SELECT {d}, sum(mass) AS mass, pow(sum(mass), {temperature}) AS share FROM cells GROUP BY {d})")
        ctes.append(f"s_{d}0 AS MATERIALIZED (SELECT max(target) / sum(share) AS s FROM m_{d}, whole)")
        for i in range(LIMIT_ROUNDS):
            ctes.append(
                f"s_{d}{i + 1} AS MATERIALIZED (SELECT coalesce((max(target) - coalesce(sum(mass) FILTER (share * s >= mass), 0)) / sum(share) FILTER (share * s < mass), max(s)) AS s FROM m_{d}, whole, s_{d}{i})"
            )
        ctes.append(f"g_{d} AS MATERIALIZED (SELECT {d}, least(mass, share * s) AS goal_{d} FROM m_{d}, s_{d}{LIMIT_ROUNDS})")
    names = "source, lang, topic, mass, goal_source, goal_lang, goal_topic"
    step = "(SELECT * FROM fit WHERE k < {0} AND (off IS NULL OR off > {1} * (SELECT target FROM whole)))".format(MOST_SWEEPS, TOLERANCE)
    for _ in range(CHUNK):
        for d in DIMENSIONS:
            full = f"sum(CASE WHEN kept >= mass THEN mass ELSE 0.0 END) OVER (PARTITION BY {d})"
            step = f"(SELECT *, sum(kept) OVER (PARTITION BY {d}) AS total, {full} AS filled FROM {step})"
            factor = f"CASE WHEN total < goal_{d} THEN CASE WHEN total > filled THEN (goal_{d} - filled) / (total - filled) ELSE 1.0 END WHEN total > 0 THEN goal_{d} / total ELSE 1.0 END"
            step = f"(SELECT k, {names}, CASE WHEN kept >= mass AND total < goal_{d} THEN mass ELSE least(mass, kept * ({factor})) END AS kept, off FROM {step})"
    off = "greatest(" + ", ".join(f"abs(sum(kept) OVER (PARTITION BY {d}) - goal_{d})" for d in DIMENSIONS) + ")"
    ctes.append(f"base AS MATERIALIZED (SELECT cells.*, {', '.join(f'goal_{d}' for d in DIMENSIONS)} FROM cells {' '.join(f'JOIN g_{d} USING ({d})' for d in DIMENSIONS)})")
    ctes.append(
        f"""fit AS (SELECT 0 AS k, {names}, mass * CAST({budget} AS DOUBLE) AS kept, CAST(NULL AS DOUBLE) AS off FROM base
  UNION ALL SELECT k + {CHUNK}, {names}, kept, max(d) OVER () AS off FROM (SELECT k, {names}, kept, {off} AS d FROM {step}))"""
    )
    ctes.append("p AS MATERIALIZED (SELECT source, lang, topic, kept / mass AS p FROM fit WHERE k = (SELECT max(k) FROM fit))")
    return (
        "WITH RECURSIVE "
        + ",\n".join(ctes)
        + f"""
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability,
  CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept
FROM own JOIN p USING (source, lang, topic)"""
    )
