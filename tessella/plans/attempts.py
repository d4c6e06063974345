"""Queries of attempts: protocol replay, records and their rules, manifests, and how they belong together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import protocol, records
from tessella.plans.registry import query, r4, sql_r4, with_

# Attempts of up to seven events: the orders and their lines. The texts of these views hold in both engines.

_PATHS = [
    ["rate-initial", "accept-original", "export"],
    ["rate-initial", "start-editing", "confirm-editing", "rate-corrected-mask", "rate-blind-pattern", "export"],
    ["rate-initial", "start-editing", "cancel-editing", "export"],
    ["rate-initial", "record-error", "export"],
    ["rate-initial", "start-editing", "record-error", "export"],
    ["rate-initial", "accept-original"],
    ["rate-initial", "start-editing", "confirm-editing", "record-error", "export"],
    ["rate-initial", "start-editing", "confirm-editing", "rate-corrected-mask", "export"],
]
_TYPE = " ".join(f"WHEN l_orderkey % {len(_PATHS)} = {p} AND l_linenumber = {n + 1} THEN '{e}'" for p, path in enumerate(_PATHS) for n, e in enumerate(path))
GATE_EVENT = f"""SELECT l_orderkey AS attempt_id, l_linenumber AS ord, CASE WHEN l_partkey % 37 = 0 THEN 'jump' {_TYPE} ELSE 'export' END AS type,
 CASE WHEN l_suppkey % 53 = 0 THEN NULL ELSE l_linenumber * 1000e0 + l_quantity END AS at, CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE l_orderkey % {len(_PATHS)} = 0 OR l_linenumber > 1 END AS acceptable,
 CASE WHEN l_partkey % 5 = 0 THEN 'tie' WHEN l_partkey % 11 = 0 THEN 'both' ELSE 'left' END AS choice, CASE WHEN l_partkey % 13 = 0 THEN ' ' ELSE 'E1' END AS code, l_returnflag AS message, l_partkey % 17 <> 0 AS has_snapshot FROM lineitem"""

_TERMINAL = "('accepted','cancelled','error','blind-pattern-rated')"
_REPLAY = f"""WITH RECURSIVE ev AS MATERIALIZED ({GATE_EVENT}),
sound AS (SELECT *, CASE WHEN type IN ('rate-initial', 'rate-corrected-mask') THEN acceptable IS NOT NULL WHEN type = 'rate-blind-pattern' THEN choice IN ('left', 'right', 'tie')
 WHEN type = 'record-error' THEN trim(code) <> '' AND trim(message) <> '' WHEN type = 'confirm-editing' THEN has_snapshot ELSE true END AS sound FROM ev),
kind AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY ord, CASE WHEN sound.at IS NULL THEN '!time' WHEN type = 'jump' THEN '!unknown-event' WHEN NOT sound.sound THEN type || '!' WHEN type = 'rate-initial' THEN type || CASE WHEN acceptable THEN '+' ELSE '-' END ELSE type END) AS nth FROM sound),
run AS (SELECT attempt_id, CAST(0 AS BIGINT) AS nth, 'sample-loaded' AS stage, CAST(NULL AS BOOLEAN) AS rated, CAST(NULL AS VARCHAR) AS error FROM ev GROUP BY attempt_id
 UNION ALL
 SELECT attempt_id, nth, CASE WHEN why IS NOT NULL THEN stage WHEN type = 'rate-initial' THEN 'initial-rated' WHEN type = 'accept-original' THEN 'accepted' WHEN type = 'start-editing' THEN 'editing' WHEN type = 'confirm-editing' THEN 'confirmed'
   WHEN type = 'cancel-editing' THEN 'cancelled' WHEN type = 'record-error' THEN 'error' WHEN type = 'rate-corrected-mask' THEN 'corrected-mask-rated' WHEN type = 'rate-blind-pattern' THEN 'blind-pattern-rated' ELSE 'exported' END,
   CASE WHEN why IS NULL AND type = 'rate-initial' THEN acceptable WHEN why IS NULL THEN NULL ELSE rated END, why FROM (
  SELECT r.attempt_id, k.nth, r.stage, r.rated, k.type, k.acceptable, CASE WHEN k.at IS NULL THEN 'time' WHEN k.type = 'jump' THEN 'unknown-event'
   WHEN k.type = 'rate-initial' AND r.stage <> 'sample-loaded' THEN 'stage' WHEN k.type IN ('accept-original', 'start-editing') AND r.stage <> 'initial-rated' THEN 'stage'
   WHEN k.type = 'accept-original' AND NOT r.rated THEN 'rating' WHEN k.type = 'start-editing' AND r.rated THEN 'rating' WHEN k.type IN ('confirm-editing', 'cancel-editing') AND r.stage <> 'editing' THEN 'stage'
   WHEN k.type = 'record-error' AND r.stage NOT IN ('initial-rated', 'editing', 'confirmed') THEN 'stage' WHEN k.type = 'rate-corrected-mask' AND r.stage <> 'confirmed' THEN 'stage'
   WHEN k.type = 'rate-blind-pattern' AND r.stage <> 'corrected-mask-rated' THEN 'stage' WHEN k.type = 'export' AND r.stage NOT IN {_TERMINAL} THEN 'stage' WHEN NOT k.sound THEN 'payload' END AS why
  FROM run r JOIN kind k ON k.attempt_id = r.attempt_id AND k.nth = r.nth + 1 WHERE r.error IS NULL))
SELECT attempt_id, stage, coalesce(CAST(rated AS VARCHAR), 'none') AS rated, coalesce(error, 'none') AS error FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY nth DESC) AS latest FROM run) WHERE latest = 1"""


def _lines(spark, sf_dir):
    return spark.sql(GATE_EVENT.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query(_REPLAY)
def protocol_replay(spark, sf_dir):
    out = protocol.replayed(_lines(spark, sf_dir))
    return out.select("attempt_id", "stage", *(F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in ("rated", "error")))


@query(f"SELECT stage, error, count(*) AS attempts FROM ({_REPLAY}) GROUP BY ALL")
def protocol_errors(spark, sf_dir):
    return protocol_replay(spark, sf_dir).groupBy("stage", "error").agg(F.count("*").alias("attempts"))


# Records: the events table as attempts, some of them broken on purpose.

ATTEMPT = """SELECT event_id AS attempt_id, concat('img-', CAST(event_id % 900 AS VARCHAR(12))) AS image_id, concat('rater', CAST(user_id % 7 AS VARCHAR(12))) AS rater_id,
 CASE event_id % 43 WHEN 0 THEN 'v1' ELSE 'mask-gate-v2' END AS protocol_version, CASE event_id % 47 WHEN 0 THEN ' ' ELSE 'set-1' END AS dataset_id,
 CASE user_id % 4 WHEN 0 THEN 'portrait' WHEN 1 THEN 'pet' WHEN 2 THEN 'illustration' ELSE 'object' END AS category, CASE WHEN event_id % 3 = 0 THEN 'clean-control' ELSE 'targeted-failure' END AS cohort,
 CASE event_id % 29 WHEN 0 THEN 'hair,hair' WHEN 1 THEN '' ELSE 'hair,edge' END AS tags, event_id % 61 AS sample_order,
 CASE event_type WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'cancelled' WHEN 'error' THEN 'error' ELSE 'confirmed' END AS outcome, event_type = 'view' OR event_id % 31 = 0 AS initial_ok,
 CASE WHEN event_type IN ('purchase', 'signup', 'click') OR event_id % 59 = 0 THEN value * 10e0 END AS started_at, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN value * 10e0 + (event_id % 50 - 1) * 100e0 END AS ended_at,
 event_id % 9 AS strokes, event_id % 4 AS adds, event_id % 8 AS cursor_at, CASE event_id % 23 WHEN 0 THEN 'rev-b' ELSE 'rev-a' END AS base_revision, 'rev-a' AS source_revision,
 CASE WHEN event_type IN ('purchase', 'signup') AND event_id % 19 <> 0 THEN 'rev-c' WHEN event_id % 67 = 0 THEN 'rev-d' END AS confirmed_revision, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type = 'purchase' END AS subject_ok,
 CASE WHEN event_type = 'error' AND event_id % 5 <> 0 THEN 'E7' END AS error_code, (event_id % 103) / 100e0 AS confidence, event_id % 24 AS width, 24 AS height, CASE event_id % 3 WHEN 0 THEN 'touch' WHEN 1 THEN 'mouse' ELSE 'finger' END AS modality,
 CASE event_id % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'right' WHEN 2 THEN 'none' ELSE 'left' END AS choice, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS left_variant FROM events"""
SAMPLE = """SELECT concat(CASE o_orderkey % 71 WHEN 0 THEN '-' ELSE '' END, 'img-', CAST(o_orderkey % 950 AS VARCHAR(12)), CASE o_orderkey % 73 WHEN 0 THEN '!' ELSE '' END) AS image_id, CASE o_custkey % 5 WHEN 0 THEN 'portrait' WHEN 1 THEN 'pet' WHEN 2 THEN 'illustration' WHEN 3 THEN 'object' ELSE 'car' END AS category,
 CASE WHEN o_orderkey % 3 = 0 THEN 'clean-control' ELSE 'targeted-failure' END AS cohort, CASE o_orderkey % 29 WHEN 0 THEN 'hair,hair' WHEN 1 THEN '' ELSE 'edge,hair' END AS tags, o_orderkey % 3 AS subject_count,
 CASE o_orderkey % 7 WHEN 0 THEN 'stolen' WHEN 1 THEN 'licensed' ELSE 'owned' END AS permission, CASE o_orderkey % 11 WHEN 0 THEN '' ELSE o_orderpriority END AS reference FROM orders"""


def _view(spark, sf_dir, text, table):
    return spark.sql(text.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


_ACTIVE = "least(cursor_at, strokes)"
_CORRECTED = "(outcome = 'confirmed' OR outcome = 'cancelled' OR (outcome = 'error' AND started_at IS NOT NULL))"
_BROKEN = f"""concat_ws(',', CASE WHEN attempt_id IS NULL THEN 'attempt_id' END, CASE WHEN NOT coalesce(protocol_version = 'mask-gate-v2', false) THEN 'protocol_version' END, CASE WHEN coalesce(trim(dataset_id), '') = '' THEN 'dataset_id' END,
 CASE WHEN coalesce(tags, '') = '' OR len(list_distinct(string_split(tags, ','))) <> len(string_split(tags, ',')) THEN 'failure_tags' END, CASE WHEN sample_order < 1 THEN 'sample_order' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END,
 CASE WHEN width < 1 THEN 'snapshot' END, CASE WHEN modality NOT IN ('touch', 'pen', 'mouse') THEN 'device' END, CASE WHEN (outcome = 'accepted') <> initial_ok THEN 'rating' END,
 CASE WHEN {_CORRECTED} AND base_revision <> source_revision THEN 'base_revision' END, CASE WHEN {_CORRECTED} AND NOT coalesce(ended_at >= started_at, false) THEN 'duration' END, CASE WHEN {_CORRECTED} AND cursor_at > strokes THEN 'cursor' END,
 CASE WHEN outcome = 'confirmed' AND (confirmed_revision IS NULL OR subject_ok IS NULL) THEN 'confirmation_missing' END, CASE WHEN outcome <> 'confirmed' AND (confirmed_revision IS NOT NULL OR subject_ok IS NOT NULL) THEN 'confirmation_only' END,
 CASE WHEN (outcome = 'error') <> (error_code IS NOT NULL) THEN 'error_details' END)"""


@query(f"SELECT attempt_id, {_BROKEN} AS broken FROM ({ATTEMPT})")
def record_violations(spark, sf_dir):
    attempts = _view(spark, sf_dir, ATTEMPT, "events")
    return attempts.select("attempt_id", records.broken(records.interaction_rules()).alias("broken"))


@query(
    f"""SELECT attempt_id, image_id, outcome, CASE WHEN {_CORRECTED} THEN {sql_r4('ended_at - started_at')} END AS duration_ms, CASE WHEN {_CORRECTED} THEN {_ACTIVE} ELSE 0 END AS stroke_count, CASE WHEN {_CORRECTED} THEN least(adds, {_ACTIVE}) ELSE 0 END AS add_count,
 CASE WHEN {_CORRECTED} THEN {_ACTIVE} - least(adds, {_ACTIVE}) ELSE 0 END AS erase_count, confirmed_revision FROM ({ATTEMPT}) WHERE {_BROKEN} = ''"""
)
def interaction_records(spark, sf_dir):
    out = records.interactions(_view(spark, sf_dir, ATTEMPT, "events"))
    return out.withColumn("duration_ms", r4(F.col("duration_ms")))


@query(
    f"""SELECT concat(image_id, ':', rater_id) AS preference_id, attempt_id, CASE WHEN choice = 'tie' THEN 'tie' WHEN choice = 'left' THEN left_variant WHEN left_variant = 'before' THEN 'after' ELSE 'before' END AS preference
 FROM ({ATTEMPT}) WHERE outcome = 'confirmed' AND {_BROKEN} = '' AND choice IN ('left', 'right', 'tie')"""
)
def preference_records(spark, sf_dir):
    return records.preferences(_view(spark, sf_dir, ATTEMPT, "events"))


_SAMPLE_BROKEN = """concat_ws(',', CASE WHEN NOT regexp_matches(image_id, '^[a-zA-Z0-9][a-zA-Z0-9_-]{0,79}$') THEN 'image_id' END, CASE WHEN category NOT IN ('portrait', 'pet', 'illustration', 'object') THEN 'category' END, CASE WHEN cohort NOT IN ('targeted-failure', 'clean-control', 'extreme') THEN 'cohort' END,
 CASE WHEN coalesce(tags, '') = '' OR len(list_distinct(string_split(tags, ','))) <> len(string_split(tags, ',')) THEN 'failure_tags' END, CASE WHEN subject_count < 1 THEN 'subject_count' END, CASE WHEN permission NOT IN ('owned', 'licensed', 'public-domain', 'research-consent') THEN 'permission' END,
 CASE WHEN trim(reference) = '' THEN 'reference' END, CASE WHEN count(*) OVER (PARTITION BY image_id) > 1 THEN 'duplicate' END)"""


@query(f"SELECT broken, count(*) AS samples FROM (SELECT {_SAMPLE_BROKEN} AS broken FROM ({SAMPLE})) GROUP BY broken")
def manifest_violations(spark, sf_dir):
    samples = records.with_duplicates(_view(spark, sf_dir, SAMPLE, "orders"), "image_id")
    return samples.groupBy(records.broken(records.sample_rules()).alias("broken")).agg(F.count("*").alias("samples"))


_FIRST = f"first_sample AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY category, cohort, tags) AS nth FROM ({SAMPLE})) WHERE nth = 1)"


@query(
    with_(_FIRST, f"attempt AS MATERIALIZED ({ATTEMPT})")
    + """SELECT CASE WHEN s.image_id IS NULL THEN 'absent' WHEN a.category <> s.category OR a.cohort <> s.cohort OR list_sort(string_split(a.tags, ',')) <> list_sort(string_split(s.tags, ',')) THEN 'metadata' ELSE 'agrees' END AS verdict, count(*) AS attempts
 FROM attempt a LEFT JOIN first_sample s USING (image_id) GROUP BY 1
 UNION ALL SELECT 'unrated', count(*) FROM first_sample WHERE image_id NOT IN (SELECT image_id FROM attempt)"""
)
def manifest_agreement(spark, sf_dir):
    first = F.min(F.struct("category", "cohort", "tags")).alias("s")
    samples = _view(spark, sf_dir, SAMPLE, "orders").groupBy("image_id").agg(first).select("image_id", "s.*")
    return records.against_manifest(_view(spark, sf_dir, ATTEMPT, "events"), samples)


@query(
    f"""WITH attempt AS MATERIALIZED ({ATTEMPT}), pref AS (SELECT attempt_id, concat(image_id, ':', rater_id) AS preference_id, attempt_id + CASE WHEN attempt_id % 13 = 0 THEN 1 ELSE 0 END AS of_attempt, dataset_id, width + CASE WHEN attempt_id % 17 = 0 THEN 1 ELSE 0 END AS width FROM attempt WHERE choice <> 'none')
SELECT p.attempt_id, CASE WHEN count(*) OVER (PARTITION BY preference_id) > 1 THEN 'duplicate' WHEN i.attempt_id IS NULL OR i.outcome <> 'confirmed' THEN 'unconfirmed' WHEN p.dataset_id <> i.dataset_id THEN 'identity' WHEN p.width <> i.width THEN 'snapshot' ELSE 'agrees' END AS verdict
 FROM pref p LEFT JOIN attempt i ON i.attempt_id = p.of_attempt"""
)
def preference_agreement(spark, sf_dir):
    attempts = _view(spark, sf_dir, ATTEMPT, "events")
    shifted = lambda c, n: F.col(c) + F.when(F.col("attempt_id") % n == 0, 1).otherwise(0)
    preferences = attempts.where("choice <> 'none'").select("attempt_id", F.concat("image_id", F.lit(":"), "rater_id").alias("preference_id"), shifted("attempt_id", 13).alias("of_attempt"), "dataset_id", shifted("width", 17).alias("width"))
    return records.against_interactions(preferences, attempts)


# Requests to the engine, most of them sound.

REQUEST = """SELECT p_partkey AS id, CASE WHEN p_partkey % 31 = 0 THEN 3000 ELSE 10 + p_partkey % 1900 END AS width, CASE WHEN p_partkey % 37 = 0 THEN 0 ELSE 12 + p_partkey % 2030 END AS height, 8 + p_partkey % 92 AS canvas_w, 8 + p_partkey % 87 AS canvas_h,
 CASE WHEN p_partkey % 41 = 0 THEN 129 ELSE 24 END AS colors, p_partkey % 50 AS max_colors, 1 + p_partkey % 13 AS canvases, p_partkey % 34 - 1 AS refinements, CASE p_partkey % 6 WHEN 0 THEN 'faithful' WHEN 1 THEN 'cute' WHEN 2 THEN 'soft' WHEN 3 THEN 'bold' ELSE 'simple' END AS style,
 CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'subject-shape' ELSE 'full-frame' END AS occupancy, p_partkey % 260 AS background, p_partkey % 104 / 100e0 AS confidence, CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE p_partkey % 9 - 1e0 END AS crop_w, 4e0 AS crop_h,
 CASE WHEN p_partkey % 31 = 0 THEN 3000 ELSE 10 + p_partkey % 1900 END + CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END AS mask_w, CASE WHEN p_partkey % 37 = 0 THEN 0 ELSE 12 + p_partkey % 2030 END AS mask_h, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 11 / 10e0 END AS mask_top,
 (p_partkey % 23 - 1) * 500e0 AS timeout_ms FROM part"""
_UNSOUND = """concat_ws(',', CASE WHEN NOT (width BETWEEN 1 AND 2048 AND height BETWEEN 1 AND 2048 AND width * height <= 4000000) THEN 'image' END, CASE WHEN NOT (canvas_w <= 96 AND canvas_h <= 96 AND canvas_w * canvas_h <= 9216) THEN 'canvas' END, CASE WHEN colors NOT BETWEEN 1 AND 128 THEN 'palette' END,
 CASE WHEN max_colors NOT BETWEEN 1 AND 48 THEN 'max_colors' END, CASE WHEN canvases NOT BETWEEN 1 AND 12 THEN 'canvases' END, CASE WHEN refinements NOT BETWEEN 0 AND 32 THEN 'refinements' END, CASE WHEN style = 'bold' THEN 'style' END, CASE WHEN background > 255 THEN 'background' END, CASE WHEN confidence > 1 THEN 'confidence' END,
 CASE WHEN NOT coalesce(crop_w > 0, false) THEN 'crop' END, CASE WHEN mask_top IS NOT NULL AND (mask_w <> width OR mask_h <> height) THEN 'mask' END, CASE WHEN occupancy = 'subject-shape' AND NOT (coalesce(mask_top, 0) >= 0.5 AND confidence BETWEEN 0.5 AND 99) THEN 'subject' END, CASE WHEN timeout_ms <= 0 THEN 'timeout' END)"""


@query(f"SELECT id, {_UNSOUND} AS broken FROM ({REQUEST})")
def request_violations(spark, sf_dir):
    return _view(spark, sf_dir, REQUEST, "part").select("id", records.broken(records.request_rules()).alias("broken"))
