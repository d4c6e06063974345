"""Queries of the rules of plans: orders are plans, their lines are budgets, cells, roles, colours and measures."""

from __future__ import annotations

from tessella.operators import plan_rules
from tessella.plans.registry import query

# These texts hold in both engines. A few remainders make faults.

CANVAS = """SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 20 + o_orderkey % 40 END AS width, 24 AS height, 0e0 AS crop_x, 1e0 AS crop_y, CASE WHEN o_custkey % 53 = 0 THEN 0e0 ELSE 5e0 END AS crop_w, CASE WHEN o_custkey % 59 = 0 THEN NULL ELSE 4e0 END AS crop_h,
 CASE o_custkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'subject-shape' ELSE 'full-frame' END AS occupancy, o_custkey % 103 / 100e0 AS coverage, o_orderkey % 1500 AS beads, o_orderkey % 3 > 0 AS feasible, CASE WHEN o_orderkey % 3 > 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE 'a,a' END AS reasons, o_custkey % 7 / 6e0 AS score FROM orders"""
BUDGET = """SELECT l_orderkey AS plan_id, l_suppkey % 40 AS feature, CASE l_partkey % 11 WHEN 0 THEN 'tail' WHEN 1 THEN 'mouth' WHEN 2 THEN 'body' ELSE 'eye' END AS kind, l_partkey % 3 AS least, 2 + l_suppkey % 3 AS preferred, CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 6 END AS most, l_suppkey % 8 AS allocated,
 l_partkey % 23 - 1 AS shift, l_linenumber = 1 AS hard, CASE WHEN l_suppkey % 71 = 0 THEN NULL ELSE l_orderkey % 3 > 0 END AS feasible, l_tax * 13 AS confidence, l_partkey % 29 - 0.5e0 AS contrast FROM lineitem"""
STRUCTURE = "SELECT o_orderkey AS plan_id, count(l_linenumber) + CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS width, 1 AS height, o_orderkey % 52 / 50e0 AS confidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"
CELL = "SELECT l_orderkey AS plan_id, l_linenumber - 1 AS cell, l_suppkey % 4 - 1 AS region, l_discount * 10.1e0 AS occupancy, CASE WHEN l_partkey % 73 = 0 THEN NULL ELSE 0.5e0 END AS strength FROM lineitem"
REGION = "SELECT DISTINCT l_orderkey AS plan_id, l_suppkey % 4 - 1 AS region, CASE WHEN l_partkey % 83 = 0 THEN 1.5e0 ELSE 1e0 END AS importance FROM lineitem WHERE l_suppkey % 4 > 0 AND l_partkey % 29 > 0"
OWNED = "SELECT l_orderkey AS plan_id, CASE WHEN l_partkey % 37 = 0 THEN 2 ELSE l_suppkey % 4 - 1 END AS region, CASE WHEN l_partkey % 43 = 0 THEN l_linenumber ELSE l_linenumber - 1 END AS cell FROM lineitem WHERE l_suppkey % 4 > 0 AND l_partkey % 31 > 0"
ADJACENT = """SELECT l_orderkey AS plan_id, l_suppkey % 4 - 1 AS region, l_linenumber % 3 AS other FROM lineitem WHERE l_suppkey % 4 > 0 AND l_partkey % 5 = 0
 UNION ALL SELECT l_orderkey AS plan_id, l_linenumber % 3 AS region, l_suppkey % 4 - 1 AS other FROM lineitem WHERE l_suppkey % 4 > 0 AND l_partkey % 5 = 0 AND l_partkey % 3 > 0"""
ROLE = """SELECT l_orderkey AS plan_id, l_suppkey % 30 AS role, CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE 'r' END AS region, CASE l_partkey % 9 WHEN 0 THEN 'glow' WHEN 1 THEN 'base' ELSE 'outline' END AS kind, l_partkey % 110 * 1e0 AS lightness, l_suppkey % 21 - 1e0 AS separation, l_discount * 10.1e0 AS importance FROM lineitem"""
COST = "SELECT o_orderkey AS plan_id, CASE WHEN o_custkey % 47 = 0 THEN NULL ELSE o_custkey % 31 - 1e0 END AS cost FROM orders"
SELECTED = "SELECT l_orderkey AS plan_id, l_suppkey % 20 AS color FROM lineitem"
ALLOWED = "SELECT l_orderkey AS plan_id, CASE l_linenumber % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'light' ELSE 'shadow' END AS role, l_suppkey % 20 AS color FROM lineitem WHERE l_linenumber < 5"
TAKEN = "SELECT l_orderkey AS plan_id, CASE WHEN l_partkey % 61 = 0 THEN '' WHEN l_linenumber % 2 = 0 THEN 'base' ELSE 'outline' END AS role, CASE WHEN l_partkey % 7 = 0 THEN l_partkey % 20 ELSE l_suppkey % 20 END AS color FROM lineitem WHERE l_linenumber > 2"
_NAMES = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(plan_rules.METRICS))
MEASURE = f"""SELECT l_partkey % 600 AS plan_id, CASE l_suppkey % 11 {_NAMES} END AS name, CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE true END AS available, CASE WHEN l_suppkey % 11 = 10 THEN l_quantity - 1 ELSE l_discount * 10.01e0 END AS value, l_tax * 12.51e0 AS confidence FROM lineitem"""


def _of(spark, sf_dir, *texts):
    """Views of texts that read the tables orders and lineitem."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")}
    used = lambda text: {t: df for t, df in tables.items() if t in text}
    mark = lambda text: text.replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}").replace("JOIN lineitem", "JOIN {lineitem}")
    return [spark.sql(mark(t), **used(t)) for t in texts]


def _sql(views: dict[str, str], *found: str) -> str:
    """The broken rules of each plan, from queries of (plan_id, rule)."""
    views = ", ".join(f"{name} AS MATERIALIZED ({text})" for name, text in views.items())
    return f"WITH {views}, found AS ({' UNION ALL '.join(found)}) SELECT plan_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS broken FROM found GROUP BY plan_id"


def _not(table: str, **rules: str) -> str:
    return " UNION ALL ".join(f"SELECT plan_id, '{name}' AS rule FROM {table} WHERE NOT coalesce({rule}, false)" for name, rule in rules.items())


def _twice(table: str, keys: str, rule: str) -> str:
    return f"SELECT plan_id, '{rule}' AS rule FROM {table} GROUP BY plan_id, {keys} HAVING count(*) > 1"


def _without(rows: str, others: str, match: str, rule: str) -> str:
    return f"SELECT plan_id, '{rule}' AS rule FROM {rows} o WHERE NOT EXISTS (SELECT 1 FROM {others} t WHERE t.plan_id = o.plan_id AND {match})"


@query(
    _sql(
        {"plan": CANVAS, "budget": BUDGET, "both_": "SELECT *, plan_id IN (SELECT plan_id FROM budget WHERE hard AND NOT feasible) AS failed FROM plan"},
        _not("both_", size="width > 0", crop="crop_w > 0 AND crop_h > 0", occupancy="occupancy <> 'auto'", coverage="coverage <= 1", beads="beads <= width * height", reasons_unique="reasons <> 'a,a'", reasons_match="feasible = (reasons = '')", feasible_match="feasible <> failed", score="score <= 1"),
        _not("budget", budget_kind="kind <> 'tail'", budget_counts="shift >= 0", budget_order="least <= preferred AND preferred <= most", budget_excess="allocated <= most", budget_flags="feasible IS NOT NULL", budget_infeasible="NOT feasible OR allocated >= least", budget_confidence="confidence <= 1", budget_contrast="contrast >= 0"),
        _twice("budget", "feature", "budget_unique"),
    )
)
def canvas_plan_violations(spark, sf_dir):
    return plan_rules.canvas_plan_rules(*_of(spark, sf_dir, CANVAS, BUDGET))


@query(
    _sql(
        {"plan": STRUCTURE, "cells": CELL, "region": REGION, "owned": OWNED, "adjacent": ADJACENT, "sized": "SELECT plan_id, width * height AS size FROM plan"},
        _not("plan", size="width > 0", confidence="confidence <= 1"),
        _not("(SELECT plan_id, any_value(size) AS size, count(DISTINCT cell) AS cells, count(cell) AS n FROM sized LEFT JOIN cells USING (plan_id) GROUP BY plan_id)", cells="cells = size AND n = size"),
        _not("cells", occupancy="occupancy BETWEEN 0 AND 1", strength="strength BETWEEN 0 AND 1"),
        _not("region", importance="importance <= 1"),
        _not("(SELECT * FROM owned JOIN sized USING (plan_id))", cell_range="cell < size"),
        _not("(SELECT o.plan_id, o.region, c.region AS mapped FROM owned o JOIN cells c USING (plan_id, cell))", ownership="region = mapped"),
        _not("adjacent", self_loop="region <> other"),
        _twice("region", "region", "region_unique"), _twice("owned", "cell", "cell_owners"), _twice("adjacent", "region, other", "adjacency_unique"),
        _without("(SELECT * FROM cells WHERE region <> -1)", "region", "t.region = o.region", "region_known"),
        _without("(SELECT * FROM cells WHERE region <> -1)", "owned", "t.region = o.region AND t.cell = o.cell", "cell_listed"),
        _without("adjacent", "region", "t.region = o.other", "neighbour_known"),
        _without("adjacent", "adjacent", "t.region = o.other AND t.other = o.region", "symmetric"),
    )
)
def structure_plan_violations(spark, sf_dir):
    return plan_rules.structure_plan_rules(*_of(spark, sf_dir, STRUCTURE, CELL, REGION, OWNED, ADJACENT))


@query(
    _sql(
        {"role_": ROLE},
        _not("role_", identity="trim(region) <> '' AND kind <> 'glow'", lightness="lightness BETWEEN 0 AND 100", separation="separation >= 0", importance="importance BETWEEN 0 AND 1"),
        _twice("role_", "role", "role_unique"),
    )
)
def value_plan_violations(spark, sf_dir):
    return plan_rules.value_plan_rules(*_of(spark, sf_dir, ROLE))


@query(
    _sql(
        {"plan": COST, "selected": SELECTED, "allowed": ALLOWED, "taken": TAKEN},
        _not("plan", cost="cost >= 0"), _not("(SELECT * FROM allowed UNION ALL SELECT * FROM taken)", role_named="role <> ''"),
        _twice("selected", "color", "selected_unique"), _twice("allowed", "role, color", "allowed_unique"),
        _without("taken", "selected", "t.color = o.color", "assigned_selected"),
        _without("(SELECT * FROM taken WHERE (plan_id, role) IN (SELECT (plan_id, role) FROM allowed))", "allowed", "t.role = o.role AND t.color = o.color", "assigned_allowed"),
    )
)
def palette_plan_violations(spark, sf_dir):
    return plan_rules.palette_plan_rules(*_of(spark, sf_dir, COST, SELECTED, ALLOWED, TAKEN))


@query(
    _sql(
        {"measure": MEASURE},
        _not("measure", available="available IS NOT NULL", value="value >= 0 AND (name = 'estimatedBuildMinutes' OR value <= 1)", confidence="confidence BETWEEN 0 AND 1"),
        "SELECT plan_id, 'missing' AS rule FROM measure GROUP BY plan_id HAVING count(DISTINCT name) < 11",
    )
)
def metric_violations(spark, sf_dir):
    return plan_rules.metric_rules(*_of(spark, sf_dir, MEASURE))
