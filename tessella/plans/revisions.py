"""Queries of nested identities and of confirmed corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import canonical, identities
from tessella.operators import confirm
from tessella.plans.identity import _HALVES, _hex_sql, _lane_sql
from tessella.plans.registry import query

_NUMBER = "regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '')"
_NESTED = f"""'{{"box":{{"container":"' || p_name || '","price":' || {_NUMBER.format('CAST(p_retailprice AS DOUBLE)')} || '}},"labels":{{"brand":"' || p_brand || '","maker":' || CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE '"' || p_type || '"' END || '}},"odd":' || CASE WHEN p_partkey % 2 = 1 THEN 'true' ELSE 'false' END
 || ',"size":' || p_size || ',"words":[' || array_to_string(list_transform(list_sort(string_split(p_type, ' ')), lambda w: '["' || w || '",' || {_NUMBER.format('length(w) / 4e0')} || ']'), ',') || ']}}'"""


@query(f"SELECT id, n AS canonical, sha256(n) AS identity, substr(sha256(n), 1, 32) AS generation FROM (SELECT p_partkey AS id, {_NESTED} AS n FROM part)")
def nested_identities(spark, sf_dir):
    """Records of records, maps and arrays: their canonical JSON and identities, whatever the order of their fields."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").repartition("p_partkey")  # a small file with dear rows would be one task
    words = F.transform(F.array_sort(F.split("p_type", " ")), lambda w: F.array(canonical.text(w), canonical.number(F.length(w) / 4)))
    record = F.struct(
        F.col("p_size").alias("size"), F.create_map(F.lit("maker"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")), F.lit("brand"), F.col("p_brand")).alias("labels"),
        F.struct(F.col("p_retailprice").cast("double").alias("price"), F.col("p_name").alias("container")).alias("box"), (F.col("p_partkey") % 2 == 1).alias("odd"),
    )
    rows = part.select(F.col("p_partkey").alias("id"), record.alias("record"), F.concat(F.lit("["), F.array_join(F.transform(words, identities.listed), ","), F.lit("]")).alias("words"))
    own = rows.select("id", canonical.json(F.col("record"), rows.schema["record"].dataType).alias("own"), "words")
    whole = own.select("id", F.concat(F.substring("own", F.lit(1), F.length("own") - 1), F.lit(',"words":'), F.col("words"), F.lit("}")).alias("canonical"))
    return whole.select("id", "canonical", F.sha2("canonical", 256).alias("identity"), F.substring(F.sha2("canonical", 256), 1, 32).alias("generation"))


_SESSION = """turn_ AS (SELECT conv_id AS session, turn, CASE WHEN role = 'assistant' THEN 'erase' ELSE 'add' END AS mode, length(text) % 101 / 100e0 AS px FROM conversations),
log_ AS (SELECT session, '[' || string_agg('["s' || turn || '","' || mode || '",0.25,[[' || regexp_replace(CAST(px AS VARCHAR), '\\.0$', '') || ',0.5]]]', ',' ORDER BY turn) || ']' AS l FROM turn_ GROUP BY session),
full_ AS (SELECT session, 'r' || session % 50 || ':8:8:mask' || chr(0) || l AS n FROM log_)"""
_PRINT = f"'{confirm.PREFIX}' || {_hex_sql(_lane_sql(_HALVES, identities.FIRST))} || {_hex_sql(_lane_sql(_HALVES, identities.SECOND))}"


def _confirmed(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    point = F.struct((F.length("text") % 101 / 100).alias("x"), F.lit(0.5).alias("y"))
    stroke = F.struct("turn", F.concat(F.lit(" s"), "turn", F.lit(" ")).alias("id"), F.when(F.col("role") == "assistant", "erase").otherwise("add").alias("mode"), F.lit(0.25).alias("radius"), F.array(point).alias("points"))
    # A log has at most MOST_STROKES strokes; longer ones are an error.
    logs = turns.groupBy(F.col("conv_id").alias("session")).agg(F.array_sort(F.collect_list(stroke)).alias("strokes"))
    sessions = logs.withColumn("base_revision", F.concat(F.lit("r"), F.col("session") % 50))
    numbers = turns.select((F.col("conv_id") % 50).alias("k")).distinct().where("k % 7 <> 3")
    origin = F.array(F.struct(F.when(F.col("k") % 2 == 0, " model ").otherwise("user").alias("origin"), F.lit("p").alias("provider"), F.lit("").alias("model"), F.lit("2").alias("version")))
    name = F.concat(F.lit("r"), "k")
    evidence = numbers.select(name.alias("revision"), F.concat(name, F.lit(":8:8:mask")).alias("base_identity"), F.when(F.col("k") % 5 == 0, "ai").otherwise("alpha").alias("source"), origin.alias("provenance"))
    return confirm.confirmed(evidence, sessions), evidence


@query(
    f"""WITH {_SESSION} SELECT session, 'r' || session % 50 AS base_revision, CASE WHEN session % 50 % 7 <> 3 THEN {_PRINT} END AS revision, CASE WHEN session % 50 % 7 <> 3 THEN CASE WHEN session % 50 % 5 = 0 THEN 'ai+manual' ELSE 'manual' END END AS source,
 session % 50 % 7 <> 3 AS user_confirmed, CASE WHEN session % 50 % 7 = 3 THEN NULL WHEN session % 50 % 2 = 0 THEN 'manual/mask-editor/1,model/p/2' ELSE 'manual/mask-editor/1,user/p/2' END AS origins, CASE WHEN session % 50 % 7 = 3 THEN 'base-revision' ELSE '' END AS errors FROM full_"""
)
def confirmed_revisions(spark, sf_dir):
    """Sessions confirmed on their base: the same log gives the same revision, an unknown base none."""
    out, _ = _confirmed(spark, sf_dir)
    origins = F.array_join(F.transform("provenance", lambda e: F.concat_ws("/", e.origin, e.provider, e.version)), ",")
    return out.select("session", "base_revision", "revision", "source", "user_confirmed", origins.alias("origins"), F.array_join("errors", ",").alias("errors"))


@query("SELECT conv_id AS session, 'r' || conv_id % 50 AS base_revision FROM conversations WHERE conv_id % 50 % 7 = 3 GROUP BY conv_id")
def broken_revisions(spark, sf_dir):
    """Sessions whose base is no revision that is known."""
    out, evidence = _confirmed(spark, sf_dir)
    links = out.select(F.concat(F.lit("session "), "session").alias("revision"), "base_revision")
    found = confirm.broken_links(links, evidence.select("revision"))
    return found.select(F.substring("revision", 9, 20).cast("long").alias("session"), "base_revision")
