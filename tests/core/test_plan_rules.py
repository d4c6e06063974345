"""Rules of plans against plain loops over odd rows, and how often they read their tables."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.operators import plan_rules

SCHEMAS = {
    "plans": "plan_id long, width long, height int, confidence double",
    "cells": "plan_id long, cell long, region long, occupancy double, strength double",
    "regions": "plan_id long, region long, importance double",
    "owned": "plan_id long, region long, cell long",
    "adjacent": "plan_id long, region long, other long",
}


def odd(rng, n, plans=40):
    """Rows of small numbers, some null, some twice, some out of range."""
    some = lambda low, high, lost=0.04: None if rng.random() < lost else int(rng.integers(low, high))
    unit = lambda: None if rng.random() < 0.02 else 1.5 if rng.random() < 0.02 else float(rng.random())
    plan = lambda: some(0, plans, 0.02)
    return {
        "plans": [(plan(), some(0, 4), some(0, 3), unit()) for _ in range(plans)],
        "cells": [(plan(), some(0, 3), some(-2, 2), unit(), unit()) for _ in range(n)],
        "regions": [(plan(), some(-1, 2), unit()) for _ in range(n // 2)],
        "owned": [(plan(), some(-1, 2), some(-1, 3)) for _ in range(n // 2)],
        "adjacent": [(plan(), some(-1, 3), some(-1, 3)) for _ in range(n // 3)],
    }


def whole():
    """A plan that breaks no rule: three cells in a row, two regions side by side, and one cell of none."""
    return {
        "plans": [(99, 3, 1, 1.0)], "cells": [(99, 0, 1, 1.0, 1.0), (99, 1, 2, 0.0, 0.5), (99, 2, -1, 0.0, 0.0)], "regions": [(99, 1, 1.0), (99, 2, 0.5)], "owned": [(99, 1, 0), (99, 2, 1)],
        "adjacent": [(99, 1, 2), (99, 2, 1)],
    }


def structure(t):
    """{plan: rules that it breaks}, rule by rule and pair by pair; a null equals nothing."""
    found = defaultdict(set)
    same = lambda a, b: None not in a and None not in b and a == b
    unit = lambda v: v is not None and 0 <= v <= 1
    whole = lambda v, least=0: v is not None and v >= least

    def rule(name, plan, holds):
        if not holds:
            found[plan].add(name)

    size = lambda w, h: None if w is None or h is None else w * h
    for p, w, h, c in t["plans"]:
        rule("size", p, whole(w, 1) and whole(h, 1))
        rule("confidence", p, unit(c))
        own = [r[1] for r in t["cells"] if same((r[0],), (p,))]
        rule("cells", p, bool(own) and len({x for x in own if x is not None}) == len(own) == size(w, h))
    for p, c, r, o, s in t["cells"]:
        rule("occupancy", p, unit(o))
        rule("strength", p, unit(s))
        rule("region_id", p, whole(r, -1))
        if r is not None and r != -1:
            rule("region_known", p, any(same((p, r), x[:2]) for x in t["regions"]))
            rule("cell_listed", p, any(same((p, r, c), x) for x in t["owned"]))
    for p, r, i in t["regions"]:
        rule("region_id", p, whole(r))
        rule("importance", p, unit(i))
    for p, r, c in t["owned"]:
        for q, w, h, _ in t["plans"]:
            if same((p,), (q,)):
                rule("cell_range", p, whole(c) and size(w, h) is not None and c < size(w, h))
        for x in t["cells"]:
            if same((p, c), x[:2]):
                rule("ownership", p, same((r,), (x[2],)))
    for p, r, o in t["adjacent"]:
        rule("self_loop", p, None not in (r, o) and r != o)
        rule("neighbour_known", p, any(same((p, o), x[:2]) for x in t["regions"]))
        rule("symmetric", p, any(same((p, o, r), x) for x in t["adjacent"]))
    for name, keys in (("region_unique", [x[:2] for x in t["regions"]]), ("cell_owners", [(x[0], x[2]) for x in t["owned"]]), ("adjacency_unique", t["adjacent"])):
        for key, n in Counter(keys).items():
            rule(name, key[0], n == 1)
    return {p: ",".join(sorted(v)) for p, v in found.items()}


def frames(spark, t):
    return [spark.createDataFrame(t[n], s) for n, s in SCHEMAS.items()]


@pytest.mark.parametrize("seed", range(3))
def test_structure_rules_match_plain_loops(spark, seed):
    t = odd(np.random.default_rng(seed), 30 + 60 * seed)
    t = {n: [*t[n], *rows] for n, rows in whole().items()}
    got = {r.plan_id: r.broken for r in plan_rules.structure_plan_rules(*frames(spark, t)).collect()}
    assert got == structure(t) and 99 not in got and None in got


@pytest.mark.parametrize("table", SCHEMAS)
def test_structure_rules_without_rows_of_a_table_or_of_others(spark, table):
    t = whole()
    for some in (t | {table: []}, {n: rows if n == table else [] for n, rows in t.items()}, {n: [] for n in t}):
        assert {r.plan_id: r.broken for r in plan_rules.structure_plan_rules(*frames(spark, some)).collect()} == structure(some)


def test_structure_rules_read_each_table_once_without_a_join(spark, tmp_path):
    for name, rows in whole().items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}")
    out = plan_rules.structure_plan_rules(*(spark.read.parquet(f"{tmp_path}/{name}") for name in SCHEMAS))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Relation [") == len(SCHEMAS) + 1  # cells are counted by place and by region
    assert out.count() == 0


def test_palette_rules_match_plain_loops(spark):
    rng = np.random.default_rng(4)
    some = lambda high: None if rng.random() < 0.05 else int(rng.integers(0, high))
    word = lambda: [None, "", "base", "light", "shadow"][int(rng.integers(0, 5))]
    plans = [(k, [None, -1.0, 2.0][k % 3]) for k in range(12)]
    selected, (allowed, taken) = [(some(12), some(4)) for _ in range(60)], ([(some(12), word(), some(4)) for _ in range(60)] for _ in range(2))
    kinds = ("plan_id long, cost double", "plan_id long, color long", *["plan_id long, role string, color long"] * 2)
    got = {r.plan_id: r.broken for r in plan_rules.palette_plan_rules(*(spark.createDataFrame(x, s) for x, s in zip((plans, selected, allowed, taken), kinds, strict=True))).collect()}
    found = defaultdict(set)
    known = lambda key, keys: None not in key and key in keys
    for p, cost in plans:
        found[p] |= set() if cost is not None and cost >= 0 else {"cost"}
    for p, role, _ in allowed + taken:
        found[p] |= set() if role else {"role_named"}
    for p, role, color in taken:
        found[p] |= set() if known((p, color), selected) else {"assigned_selected"}
        if known((p, role), [x[:2] for x in allowed]):
            found[p] |= set() if known((p, role, color), allowed) else {"assigned_allowed"}
    for name, rows in (("selected_unique", selected), ("allowed_unique", allowed)):
        for key, n in Counter(rows).items():
            found[key[0]] |= {name} if n > 1 else set()
    assert got == {p: ",".join(sorted(v)) for p, v in found.items() if v}
