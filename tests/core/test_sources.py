"""Readers, appends, streams."""

import hashlib
import json
import struct
import zlib
from time import sleep

from pyspark.sql import functions as F

from tessella.operators import protocol as batch_protocol
from tessella.plans import attempts
from tessella.sources import files
from tessella.streaming import protocol


def png(width: int, height: int, rows: list[bytes]) -> bytes:
    """An RGB image file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def test_json_lines_keep_malformed_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps({"imageId": "a", "outcome": "accepted", "device": {"class": "mobile"}}) + "\nnot json\n")
    rows = files.read_records(spark, str(tmp_path / "r.jsonl")).cache().collect()
    assert [(r.imageId, r._corrupt_record) for r in rows] == [("a", None), (None, "not json")]


def test_append_holds_each_key_once(spark):
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "imageId string")
    assert sorted(r.imageId for r in files.append_unique(rows("a"), rows("a", "b", "b", "c"), "imageId").collect()) == ["b", "c"]


def test_images_become_pixels(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(png(2, 1, [bytes([10, 20, 30, 200, 150, 100])]))
    rows = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in files.read_images(spark, str(tmp_path / "i.png")).collect()}
    assert rows == {(0, 0): (10, 20, 30, 255), (1, 0): (200, 150, 100, 255)}


def test_digests_are_checked(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"mask")
    index = spark.createDataFrame([("m.bin", hashlib.sha256(b"mask").hexdigest()), ("n.bin", "0")], "path string, sha256 string")
    assert {r.path: r.ok for r in files.verified_files(spark, str(tmp_path), index).collect()} == {"m.bin": True, "n.bin": False}


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = protocol.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "1 day", "1 day")
    run = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    batch = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").count()
    assert {tuple(r) for r in spark.table("counted").collect()} == {tuple(r) for r in batch.collect()}


def test_stream_replay_equals_batch_replay(spark, tmp_path):
    events = attempts._lines(spark, "/root/testdata/sf0.001").withColumn("time", (F.col("attempt_id") % 1000 + 1_700_000_000).cast("timestamp")).where("attempt_id % 20 < 3").cache()
    for part in (F.col("ord") <= 2, F.col("ord") > 2):  # the triggers
        events.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sleep(1.1)  # files are taken by their time
    stream = protocol.replayed(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "time")
    run = stream.writeStream.format("memory").queryName("replayed").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = {}
    for r in sorted(spark.table("replayed").collect(), key=lambda r: r.events):
        got[r.attempt_id] = (r.stage, r.rated, r.error)
    assert got == {r.attempt_id: (r.stage, r.rated, r.error) for r in batch_protocol.replayed(events).collect()} and len({v[0] for v in got.values()}) > 3
