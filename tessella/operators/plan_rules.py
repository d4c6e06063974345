"""Rules of plans and of candidates' measures: row predicates, and counts by key of a plan's tables side by side.

Each function gives plan_id and broken (the names of the broken rules, sorted, comma-joined) of the plans that break any. The few
joins are equi-joins that hold the plan's id, and counts are partial before their shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.planning import FEATURES
from tessella.operators.records import is_finite, is_integer, is_one_of, is_text, is_unit

#: The allowed words and the measures that each candidate needs.
OCCUPANCY = ("full-frame", "subject-shape", "solid-background")
ROLES = ("highlight", "light", "base", "shadow", "deep-shadow", "outline")
MINUTES = "estimatedBuildMinutes"
METRICS = (
    "sourceFidelity", "featureVisibility", "silhouetteQuality", "semanticBoundaryQuality", "regionAdjacencyPreservation", "valueOrderAccuracy",
    "paletteRoleConsistency", "clusterCleanliness", "symmetryQuality", "craftComplexity", MINUTES,
)


def _unless(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(plan_id, rule) for each rule that doesn't hold for a row; null doesn't."""
    broken = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()))
    return rows.select("plan_id", F.explode(F.array_compact(broken)).alias("rule"))


def _kept(rules: dict[str, Column]) -> list[Column]:
    """Whether each rule holds for a row, under the rule's name; null doesn't hold."""
    return [F.coalesce(rule, F.lit(False)).alias(name) for name, rule in rules.items()]


def _holds(*rules: str) -> dict[str, Column]:
    """Rules that were looked at before their rows were counted; without a row that they are about they hold."""
    return {name: F.coalesce(F.col(name), F.lit(True)) for name in rules}


def _counted(keys: list[str], **tables: DataFrame) -> DataFrame:
    """For each plan_id and keys how many rows of each table there are, under the table's name; all tables are counted in one shuffle.

    Columns beyond the keys are rules: one holds for a key if it holds for all of the key's rows that have it.
    """
    marked = [rows.withColumn(name, F.lit(1)) for name, rows in tables.items()]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    rules = [c for c in both.columns if c not in ("plan_id", *keys, *tables)]
    return both.groupBy("plan_id", *keys).agg(*(F.count(n).alias(n) for n in tables), *(F.every(r).alias(r) for r in rules))


def _repeated(rows: str) -> Column:
    """The rule that a key has one row at most."""
    return F.col(rows) <= 1


def _missing(rows: str, others: str, keys: list[str]) -> Column:
    """The rule that a key with rows has others too; a key with a null equals no other."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in ("plan_id", *keys)))
    return (F.col(rows) == 0) | ((F.col(others) > 0) & known)


def _together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, found).groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("broken"))


def canvas_plan_rules(plans: DataFrame, budgets: DataFrame) -> DataFrame:
    """plans: plan_id, width, height, crop_x, crop_y, crop_w, crop_h, occupancy, coverage, beads, feasible, reasons (comma-joined), score.

    budgets: plan_id, feature, kind, least, preferred, most, allocated, shift, hard, feasible, confidence, contrast.
    """
    crop = is_finite("crop_x") & is_finite("crop_y") & is_finite("crop_w") & is_finite("crop_h") & (F.col("crop_w") > 0) & (F.col("crop_h") > 0)
    reasons = F.split("reasons", ",")
    failed = budgets.where("hard and not feasible").select("plan_id").distinct().withColumn("failed", F.lit(True))
    of_plans = _unless(
        plans.join(failed, "plan_id", "left"),
        {
            "size": is_integer("width", 1) & is_integer("height", 1), "crop": crop, "occupancy": is_one_of("occupancy", OCCUPANCY), "coverage": is_unit("coverage"), "beads": is_integer("beads") & (F.col("beads") <= F.col("width") * F.col("height")),
            "reasons_unique": (F.col("reasons") == "") | (F.size(F.array_distinct(reasons)) == F.size(reasons)), "reasons_match": F.col("feasible") == (F.col("reasons") == ""), "feasible_match": F.col("feasible") == F.col("failed").isNull(), "score": is_unit("score"),
        },
    )
    of_budgets = _unless(
        budgets,
        {
            "budget_kind": is_one_of("kind", tuple(FEATURES)), "budget_counts": is_integer("least") & is_integer("preferred") & is_integer("most") & is_integer("allocated") & is_integer("shift"),
            "budget_order": (F.col("least") <= F.col("preferred")) & (F.col("preferred") <= F.col("most")), "budget_excess": F.col("allocated") <= F.col("most"), "budget_flags": F.col("hard").isNotNull() & F.col("feasible").isNotNull(),
            "budget_infeasible": ~F.col("feasible") | (F.col("allocated") >= F.col("least")), "budget_confidence": is_unit("confidence"), "budget_contrast": is_finite("contrast") & (F.col("contrast") >= 0),
        },
    )
    features = _counted(["feature"], budgets=budgets.select("plan_id", "feature"))
    return _together(of_plans, of_budgets, _unless(features, {"budget_unique": _repeated("budgets")}))


def structure_plan_rules(plans: DataFrame, cells: DataFrame, regions: DataFrame, owned: DataFrame, adjacent: DataFrame) -> DataFrame:
    """plans: plan_id, width, height, confidence. cells: plan_id, cell, region (-1: none), occupancy, strength. regions: plan_id, region, importance.

    owned: plan_id, region, cell, as the regions list them. adjacent: plan_id, region, other.
    """
    # Rows are counted by place, then by cell, then by plan, and by pair, then by region; rules of rows come along, so that no table is read for each rule.
    c = F.col
    places = _counted(
        ["cell", "region"],
        cells=cells.select("plan_id", "cell", "region", *_kept({"occupancy": is_unit("occupancy"), "strength": is_unit("strength"), "region_id": is_integer("region", -1)})),
        owned=owned.select("plan_id", "cell", "region", *_kept({"whole": is_integer("cell")})),
    )
    outside = F.coalesce(c("region") == -1, F.lit(True))
    listed = places.select("*", *_kept({"cell_listed": outside | _missing("cells", "owned", ["cell", "region"])}))
    of_places = ("occupancy", "strength", "region_id", "whole", "cell_listed")
    spots = listed.groupBy("plan_id", "cell").agg(F.sum("cells").alias("cells"), F.sum("owned").alias("owned"), F.count("*").alias("places"), F.count("region").alias("regions"), *(F.every(r).alias(r) for r in of_places))
    # A cell that is both mapped and listed has one region, the same in both.
    apart = (c("cells") == 0) | (c("owned") == 0) | c("plan_id").isNull() | c("cell").isNull()
    of_spots = spots.select(
        "plan_id", "cells", "owned", F.when(c("cells") > 0, c("cell")).alias("mapped"), F.when(c("owned") > 0, c("cell")).alias("listed"), *of_places,
        *_kept({"cell_owners": _repeated("owned"), "ownership": apart | ((c("places") == 1) & (c("regions") == 1))}),
    )
    of_plans = plans.select("plan_id", F.lit(1).alias("plans"), (c("width") * c("height")).alias("area"), *_kept({"size": is_integer("width", 1) & is_integer("height", 1), "confidence": is_unit("confidence")}))
    of_rows = (*of_places, "cell_owners", "ownership", "size", "confidence")
    sums = of_spots.unionByName(of_plans, allowMissingColumns=True).groupBy("plan_id").agg(
        F.count("plans").alias("plans"), F.count("area").alias("areas"), F.min("area").alias("least"), F.max("area").alias("most"), F.sum("cells").alias("rows"), F.count("mapped").alias("cells"),
        F.coalesce(F.sum("owned"), F.lit(0)).alias("owned"), F.max("listed").alias("last"), *(F.every(r).alias(r) for r in of_rows),
    )
    sized = (c("areas") == c("plans")) & c("plan_id").isNotNull()
    full = sized & (c("rows") > 0) & (c("least") == c("most")) & (c("cells") == c("least")) & (c("rows") == c("least"))
    inside = (c("plans") == 0) | (c("owned") == 0) | c("plan_id").isNull() | (c("whole") & sized & (c("last") < c("least")))
    # A pair of regions is one key, whichever of them lists the other.
    back = F.coalesce(c("region") > c("other"), F.lit(False))
    ends = (F.when(back, c("other")).otherwise(c("region")).alias("low"), F.when(back, c("region")).otherwise(c("other")).alias("high"))
    pairs = adjacent.select("plan_id", *ends, back.alias("back")).groupBy("plan_id", "low", "high").agg(F.count_if(~c("back")).alias("there"), F.count_if("back").alias("back"))
    mutual = _missing("there", "back", ["low", "high"]) & _missing("back", "there", ["low", "high"])
    of_pairs = {"self_loop": c("low") != c("high"), "adjacency_unique": _repeated("there") & _repeated("back"), "symmetric": mutual | (c("plan_id").isNotNull() & (c("low") == c("high")))}
    named = F.inline(F.array(F.struct(c("high").alias("region"), c("there").alias("n")), F.struct(c("low").alias("region"), c("back").alias("n"))))
    by_region = _counted(
        ["region"],
        regions=regions.select("plan_id", "region", *_kept({"region_id": is_integer("region"), "importance": is_unit("importance")})),
        inside=cells.where("region <> -1").select("plan_id", "region"),
        neighbours=pairs.select("plan_id", named, *_kept(of_pairs)).where("n > 0").drop("n"),
    )
    return _together(
        _unless(sums, _holds(*(r for r in of_rows if r != "whole")) | {"cells": (c("plans") == 0) | full, "cell_range": inside}),
        _unless(by_region, _holds("region_id", "importance", *of_pairs) | {"region_unique": _repeated("regions"), "region_known": _missing("inside", "regions", ["region"]), "neighbour_known": _missing("neighbours", "regions", ["region"])}),
    )


def value_plan_rules(roles: DataFrame) -> DataFrame:
    """roles: plan_id, role, region, kind, lightness, separation, importance."""
    rules = {
        "identity": is_text("region") & is_one_of("kind", ROLES), "lightness": is_finite("lightness") & F.col("lightness").between(0, 100), "separation": is_finite("separation") & (F.col("separation") >= 0), "importance": is_unit("importance"),
    }
    return _together(_unless(roles, rules), _unless(_counted(["role"], roles=roles.select("plan_id", "role")), {"role_unique": _repeated("roles")}))


def palette_plan_rules(plans: DataFrame, selected: DataFrame, allowed: DataFrame, assigned: DataFrame) -> DataFrame:
    """plans: plan_id, cost. selected: plan_id, color. allowed and assigned: plan_id, role, color; a role without allowed colours takes any."""
    bound = assigned.join(allowed.select("plan_id", "role").distinct(), ["plan_id", "role"], "left_semi")
    colors = _counted(["color"], selected=selected.select("plan_id", "color"), assigned=assigned.select("plan_id", "color"))
    choices = _counted(["role", "color"], allowed=allowed.select("plan_id", "role", "color"), bound=bound.select("plan_id", "role", "color"))
    return _together(
        _unless(plans, {"cost": is_finite("cost") & (F.col("cost") >= 0)}),
        _unless(allowed.union(assigned.select(allowed.columns)), {"role_named": is_text("role")}),
        _unless(colors, {"selected_unique": _repeated("selected"), "assigned_selected": _missing("assigned", "selected", ["color"])}),
        _unless(choices, {"allowed_unique": _repeated("allowed"), "assigned_allowed": _missing("bound", "allowed", ["role", "color"])}),
    )


def metric_rules(measures: DataFrame) -> DataFrame:
    """measures: plan_id (the candidate's), name, available, value, confidence. Each of METRICS is needed; others aren't looked at."""
    known = measures.where(F.col("name").isin(*METRICS))
    value = is_finite("value") & (F.col("value") >= 0) & ((F.col("name") == MINUTES) | (F.col("value") <= 1))
    counts = measures.groupBy("plan_id").agg(F.count_distinct(F.when(F.col("name").isin(*METRICS), F.col("name"))).alias("n"))
    return _together(_unless(known, {"available": F.col("available").isNotNull(), "value": value, "confidence": is_unit("confidence")}), _unless(counts, {"missing": F.col("n") == len(METRICS)}))
