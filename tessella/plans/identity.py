"""Queries of identities: hashes of texts, canonical records, plan and generation identities, fingerprints of arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import identities
from tessella.operators import kernels
from tessella.plans.registry import query
from tessella.sources import views

_UNITS = "list_transform(string_split(n, ''), lambda c: CAST(ascii(c) AS HUGEINT))"


def _lane_sql(values: str, lane: tuple[int, int]) -> str:
    return f"list_reduce(list_prepend(CAST({lane[0]} AS HUGEINT), {values}), lambda h, c: (xor(h, c) * {lane[1]}) % 4294967296)"


def _hex_sql(e: str) -> str:
    return f"lpad(lower(hex(CAST({e} AS BIGINT))), 8, '0')"


_PLACED = "list_transform(string_split(n, ''), lambda c, i: CAST(ascii(c) + i - 1 AS HUGEINT))"
_PAIR = f"{_hex_sql(_lane_sql(_UNITS, identities.FIRST))} || {_hex_sql(_lane_sql(_PLACED, identities.SECOND))}"
_HALVES = "flatten(list_transform(string_split(n, ''), lambda c: [CAST(ascii(c) % 256 AS HUGEINT), CAST(ascii(c) // 256 AS HUGEINT)]))"
_DIGITS = "'0123456789abcdefghijklmnopqrstuvwxyz'"
_BASE36 = f"(SELECT string_agg(substr({_DIGITS}, (h // CAST(pow(36, 6 - k) AS BIGINT)) % 36 + 1, 1), '' ORDER BY k) FROM range(7) r(k))"


@query(
    f"""WITH t AS (SELECT p_partkey AS id, p_name || '/' || p_brand AS n FROM part), h AS (SELECT *, {_PAIR} AS pair, {_hex_sql(_lane_sql(_HALVES, identities.FIRST))} || {_hex_sql(_lane_sql(_HALVES, identities.SECOND))} AS fingerprint, CAST({_lane_sql(_UNITS, identities.FIRST)} AS BIGINT) AS h FROM t)
SELECT id, pair, fingerprint, {_BASE36} AS short FROM h"""
)
def text_hashes(spark, sf_dir):
    n = F.concat("p_name", F.lit("/"), "p_brand")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), identities.paired_hash(n).alias("pair"), identities.text_fingerprint(n).alias("fingerprint"), identities.short_hash(n).alias("short"))


_CANON = """'{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',"tags":["' || array_to_string(list_sort(string_split(p_type, ' ')), '","') || '"]' END || '}'"""


@query(f"SELECT p_partkey AS id, {_CANON} AS canonical, sha256({_CANON}) AS digest, substr(sha256({_CANON}), 1, 32) AS generation FROM part")
def record_identities(spark, sf_dir):
    """Canonical records with keys and tags in order, whatever the order they come in; null entries are left out."""
    tags = F.when(F.col("p_partkey") % 3 != 0, identities.listed(F.transform(F.array_sort(F.split("p_type", " ")), identities.quoted)))
    entries = {"tags": tags, "size": F.col("p_size").cast("string"), "name": identities.quoted(F.col("p_name")), "brand": identities.quoted(F.col("p_brand"))}
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), identities.canonical(entries).alias("canonical"), identities.record_hash(entries).alias("digest"), identities.record_hash(entries, 32).alias("generation"))


_PLAN = """'{"crop":[0,0,' || n_nationkey || ',9],"mode":"full-frame","seed":"' || n_name || '","size":[' || w || ',' || h || ']}'"""


@query(
    f"""WITH t AS (SELECT n_nationkey, w, h, {_PLAN} AS n FROM nation, (VALUES (32), (48)) a(w), (VALUES (32), (40)) b(h)), k AS (SELECT *, CAST({_lane_sql(_UNITS, identities.FIRST)} AS BIGINT) AS h_ FROM t)
SELECT n_nationkey AS id, w AS width, h AS height, 'canvas-' || w || 'x' || h || '-' || {_BASE36.replace('(h //', '(h_ //')} AS plan_id FROM k"""
)
def canvas_plan_ids(spark, sf_dir):
    sizes = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")) for w in (32, 48) for h in (32, 40))))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), "n_name", sizes.alias("s")).select("id", "n_name", "s.*")
    text = lambda c: F.col(c).cast("string")
    crop, size = identities.listed(F.array(F.lit("0"), F.lit("0"), text("id"), F.lit("9"))), identities.listed(F.array(text("width"), text("height")))
    plan = identities.canonical({"crop": crop, "mode": F.lit('"full-frame"'), "seed": identities.quoted(F.col("n_name")), "size": size})
    return rows.select("id", "width", "height", F.concat(F.lit("canvas-"), "width", F.lit("x"), "height", F.lit("-"), identities.short_hash(plan)).alias("plan_id"))


@query()
def array_fingerprints(spark, sf_dir):
    """SHA-256 of a mask's values as big-endian doubles, and the two lanes over its floats and their number."""
    return kernels.fingerprints(views.mask(spark, sf_dir))
