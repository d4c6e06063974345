"""Sharding by sampled splitters: near-equal bytes in every shard, by range of a key.

The key puts equal texts next to each other: (hash of the text, doc_id, position). A size-weighted sample
of keys (`SAMPLED` for each range) gives quantile boundaries of many fine ranges; a row finds its range by binary
search in one constant array. Each range is ordered by itself; running sums of bytes, offset by the sums of the ranges before it, place every
row. A range that reaches over the end of a shard is subdivided there, also in the middle of a group of
equal texts or of repeated rows, since the position breaks all ties.

Only narrow columns (id, size, checksum, key) are shuffled, never texts. Built-in functions only.

Defined results. Null text: no bytes, crc32 of nothing. Null id: sorts first among equal texts. Repeated
rows: one output row each. Empty table: no rows. Fewer rows than shards: some shards stay empty. Extra
columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import durable

#: Bytes that each row counts besides its text.
ROW_BYTES = 16
#: Fine ranges at least, sampled keys for each of them, and rows for each of them at most on average.
RANGES, SAMPLED, RANGE_ROWS = 480, 40, 200_000


def _range_of(key: Column, boundaries: list[tuple[int, int, int]]) -> Column:
    """The number of boundaries (in rising order) up to key: from the largest power of two down, steps that don't pass key."""
    if not boundaries:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([dict(zip(("h", "id", "at"), b, strict=True)) for b in boundaries])), "array<struct<h: long, id: long, at: long>>")
    powers = F.array(*(F.lit(1 << k) for k in reversed(range(len(boundaries).bit_length()))))
    step = lambda place, p: F.when((place + p <= len(boundaries)) & (F.get(table, place + p - 1) <= key), place + p).otherwise(place)
    return F.aggregate(powers, F.lit(0), step)


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row."""
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"").cast("binary"))
    rows = durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.struct(F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.monotonically_increasing_id().alias("at")).alias("key"),
        )
    )
    totals = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total, n = totals["bytes"] or 0, totals["rows"]
    ranges = max(RANGES, -(-n // RANGE_ROWS))

    # A row is drawn as often as its size holds strides, the rest of it by chance (from the key's hash).
    stride = max(1.0, total / (ranges * SAMPLED))
    chance = F.pmod(F.xxhash64("key", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select("key", F.floor(F.col("size") / stride + chance).alias("times")).where("times > 0")
    ranked = drawn.select("key", F.sum("times").over(Window.orderBy("key")).alias("upto"), "times")
    weight = drawn.agg(F.sum("times")).first()[0] or 0
    step = max(1.0, weight / ranges)
    last_in_range = ranked.where(F.floor(F.col("upto") / step) > F.floor((F.col("upto") - F.col("times")) / step))
    boundaries = [tuple(r["key"]) for r in last_in_range.orderBy("key").collect()]

    placed = rows.withColumn("range", _range_of(F.col("key"), boundaries))
    sums = placed.groupBy("range").agg(F.sum("size").alias("range_bytes"), F.count("*").alias("range_rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("rows_before"))

    inside = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.select("doc_id", "size", "text_crc32", "range", F.sum("size").over(inside).alias("upto"), F.count("*").over(inside).alias("nth"))
    joined = summed.join(offsets, "range")
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    sharded = durable(
        joined.select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1))))).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("row"),
        )
    )
    starts = sharded.groupBy("shard").agg(F.min("row").alias("start"))
    return sharded.join(F.broadcast(starts), "shard").select(  # at most `shards` rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
