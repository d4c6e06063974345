"""Readers and writers of evaluation files: manifests, JSON lines, images, sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INTERACTION_SCHEMA = (
    "imageId string, category string, cohort string, initialSubjectAcceptable boolean, outcome string, subjectAcceptable boolean, correctionDurationMs double, strokeCount long, "
    "addStrokeCount long, eraseStrokeCount long, correctionAreaRatio double, device struct<class: string, inputModality: string>, _corrupt_record string"
)


def read_manifest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str = INTERACTION_SCHEMA) -> DataFrame:
    """JSON lines; a malformed line keeps its text in _corrupt_record."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def append_unique(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The rows of fresh whose key isn't there yet, the first of each key."""
    return fresh.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of images: origin, x, y, r, g, b, a. Spark's reader stores rows of blue, green, red."""
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * F.col("nChannels") + 1 + k, F.lit(1))), 16, 10).cast("int")
    pixels = image.select("origin", "width", "height", "nChannels", "data", at.alias("i"))
    gray = F.col("nChannels") == 1
    return pixels.select(
        "origin", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"),
        F.when(gray, byte(0)).otherwise(byte(2)).alias("r"), F.when(gray, byte(0)).otherwise(byte(1)).alias("g"), byte(0).alias("b"), F.when(F.col("nChannels") == 4, byte(3)).otherwise(255).alias("a"),
    )


def verified_files(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """index (path, sha256) with ok: whether the file's content has that digest."""
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("digest"))
    return index.join(found, F.expr("endswith(file, path)"), "left").select(index["*"], F.coalesce(F.col("digest") == F.col("sha256"), F.lit(False)).alias("ok"))
