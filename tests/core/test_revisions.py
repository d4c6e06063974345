"""Canonical JSON against Python's and the number format of scripts, and confirmed revisions against a row-wise version."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import canonical
from tessella.operators import confirm


def script_number(x):
    """A double as scripts write it."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    mantissa, power = f"{abs(x):e}".split("e")
    digits = "".join(c for c in repr(abs(x)).split("e")[0] if c.isdigit()).lstrip("0").rstrip("0")
    n, k, sign = int(power) + 1, len(digits), "-" if x < 0 else ""
    if abs(x) != 0 and float(f"{abs(x):.0e}") != abs(x):
        n = math.floor(math.log10(abs(x))) + 1
        while float(f"0.{digits}e{n}") != abs(x):
            n += 1 if float(f"0.{digits}e{n}") < abs(x) else -1
    if k <= n <= 21:
        return sign + digits + "0" * (n - k)
    if 0 < n <= 21:
        return f"{sign}{digits[:n]}.{digits[n:]}"
    if -6 < n <= 0:
        return f"{sign}0.{'0' * -n}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if k > 1 else ''}e{'+' if n > 0 else '-'}{abs(n - 1)}"


def test_numbers(spark):
    known = {0.0: "0", -0.0: "0", 1.0: "1", -1.5: "-1.5", 0.1: "0.1", 100.0: "100", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-6: "0.000001", 1e-7: "1e-7", 1.5e-9: "1.5e-9", 123456789.125: "123456789.125", 5e300: "5e+300", 1234567.0: "1234567", 0.001: "0.001", 12345678.9: "12345678.9"}
    rng = random.Random(1)
    more = [round(rng.uniform(-1, 1) * 10 ** rng.randint(-9, 12), rng.randint(0, 8)) for _ in range(400)]
    rows = spark.createDataFrame([(x,) for x in [*known, *more, float("nan"), float("inf")]], "x double")
    got = [r.j for r in rows.select(canonical.number(F.col("x")).alias("j")).collect()]
    assert got == [known.get(x) or script_number(x) for x in [*known, *more]] + ["null", "null"]


def test_texts(spark):
    texts = ["", "plain", 'quo"te', "back\\slash", "tab\tline\nfeed\r\b\f", "\x01\x1f", "é 中 😀 /"]
    got = [r.j for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.text(F.col("t")).alias("j")).collect()]
    assert got == [json.dumps(t, ensure_ascii=False) for t in texts]


PAIR = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("a", T.StringType())])
KIND = T.StructType([
    T.StructField("z", T.ArrayType(PAIR)), T.StructField("map", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))), T.StructField("flag", T.BooleanType()), T.StructField("Big", T.LongType()), T.StructField("day", T.StringType()),
])


def plain(value, omit):
    """The same by Python: keys in order, numbers as scripts write them."""
    if isinstance(value, float):
        return script_number(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{plain(v, omit)}" for k, v in sorted(value.items()) if not (omit and v is None)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(plain(v, omit) for v in value) + "]"
    return json.dumps(value, ensure_ascii=False)


@pytest.mark.parametrize("omit", [False, True])
def test_nested_records(spark, omit):
    values = [
        {"z": [{"b": 1, "a": "x"}, {"b": None, "a": None}, None], "map": {"k2": [1.0, 0.5, None], "k1": [], "none": None}, "flag": True, "Big": 2**53, "day": "ü"},
        {"z": [], "map": {}, "flag": None, "Big": None, "day": None},
        {"z": None, "map": None, "flag": False, "Big": -1, "day": '"'},
    ]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(9, None)], T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", KIND)]))
    got = {r.id: r.j for r in rows.select("id", canonical.json(F.col("v"), KIND, omit).alias("j")).collect()}
    assert got == {**{i: plain(v, omit) for i, v in enumerate(values)}, 9: "null"}
    turned = T.StructType([KIND[n] for n in ("day", "Big", "flag", "map", "z")])
    other = rows.select("id", F.struct(*(F.col(f"v.{f.name}") for f in turned)).alias("v")).where("id < 9")
    one, two = ({r.id: r.identity for r in canonical.identified(df.where("id < 9"), "v", digits=32, omit=omit).collect()} for df in (rows, other))
    assert one == two and len(set(one.values())) == 3 and all(len(h) == 32 for h in one.values())


def test_types_without_json_are_refused(spark):
    with pytest.raises(TypeError):
        canonical.json(F.col("x"), T.MapType(T.IntegerType(), T.StringType()))
    with pytest.raises(TypeError):
        canonical.json(F.col("x"), T.BinaryType())


def fingerprint(text):
    first, second = 0x811C9DC5, 0x9E3779B9
    raw = text.encode("utf-16-be")
    for high, low in zip(raw[::2], raw[1::2], strict=True):
        for b in (low, high):
            first, second = (first ^ b) * 0x01000193 & 0xFFFFFFFF, (second ^ b) * 0x85EBCA6B & 0xFFFFFFFF
    return f"{first:08x}{second:08x}"


STROKE = "struct<id: string, mode: string, radius: double, points: array<struct<x: double, y: double>>>"
EVIDENCE = "revision string, base_identity string, source string, provenance array<struct<origin: string, provider: string, model: string, version: string>>"


def stroke(name, mode="add", radius=0.25, points=((0.5, 1.0),)):
    return {"id": name, "mode": mode, "radius": radius, "points": [{"x": float(x), "y": float(y)} for x, y in points]}


def test_confirmed_sessions(spark):
    evidence = spark.createDataFrame([("r1", "r1:8:8:abc", "ai", None), ("r2", "r2:8:8:abc", "alpha", [(" model ", "p", "", "1"), ("model", "p", None, "1"), ("", "x", None, None)]), ("r3", "r3:8:8:abc", "alpha", [])], EVIDENCE)
    logs = {
        1: ("r1", [stroke("s1"), stroke("s2 é", "erase", 0.1, ((0, 0), (0.125, 1)))]), 2: ("r1", [stroke(" s1 "), stroke("s2 é ", "erase", 0.1, ((0, 0), (0.125, 1)))]), 3: ("r2", [stroke("s1")]), 4: ("r3", []), 5: ("gone", [stroke("s1")]),
        6: ("r1", [stroke("s1"), stroke(" s1")]), 7: ("r1", [stroke(" ", "paint", 0.0, ((2, 0),))]), 8: ("r1", [stroke("s1", points=())]), 9: ("r1", [stroke(f"s{i}") for i in range(513)]), 10: ("r1", [stroke("s1", radius=float("nan"))]),
    }
    sessions = spark.createDataFrame([(i, base, log) for i, (base, log) in logs.items()], f"session int, base_revision string, strokes array<{STROKE}>")
    got = {r.session: r for r in confirm.confirmed(evidence, sessions).collect()}
    log = '[["s1","add",0.25,[[0.5,1]]],["s2 é","erase",0.1,[[0,0],[0.125,1]]]]'
    assert got[1].revision == got[2].revision == f"mask-editor:v1:{fingerprint('r1:8:8:abc' + chr(0) + log)}"
    assert {i: list(r.errors) for i, r in got.items() if r.errors} == {5: ["base-revision"], 6: ["repeated-id"], 7: ["blank-id", "mode", "point", "radius"], 8: ["no-points"], 9: ["too-many"], 10: ["radius"]}
    assert all((r.revision is None) == (r.source is None) == (not r.user_confirmed) == bool(r.errors) for r in got.values())
    assert (got[1].source, got[3].source, got[4].source) == ("ai+manual", "ai+manual", "manual")
    assert [tuple(p) for p in got[3].provenance] == [("manual", "mask-editor", None, "1"), ("model", "p", None, "1")]
    assert len({got[i].revision for i in (1, 3, 4)}) == 3


def test_broken_chains_are_found(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x"), ("e", None)], "revision string, base_revision string")
    roots = spark.createDataFrame([("a",)], "revision string")
    assert sorted((r.revision, r.base_revision) for r in confirm.broken_links(links, roots).collect()) == [("d", "x"), ("e", None)]
