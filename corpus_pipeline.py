"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing and packing, one operator a stage.

Each stage takes what its predecessor kept and returns the columns of `documents`; the last returns packed
pieces. `run` stores each stage's rows as Parquet before the next reads them, and deletes what no later stage reads.

For every stage: an empty table gives no rows; columns beyond those of `documents` pass through, whatever their names (the last
stage leaves them out); texts are used whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import lines, ordinal, packing, raking, setsketch
from tessella.llm.common import discard, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an expected severity below the limit stay.

    Null, empty and blank texts have severity 0 and stay, as do all if no labels of both classes are known. Repeated rows and rows
    with a null id are judged each by its text. A severity equal to the limit is toxic.
    """
    return ordinal.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document (smaller id) holds are cut from later documents; every row stays.

    Null texts and rows with a null id stay as they are. Rows of one id aren't cut for each other. A text may become empty.
    """
    return lines.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays, that of the smallest id.

    Null and blank texts and rows with a null id are like no other and stay. Repeated rows of an id and text are one document.
    """
    return setsketch.drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights of sources, languages and topics.

    A null source or language is a value of its own; a null text counts one token. Rows of one id share their fate.
    """
    return raking.sample_mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences; a null text is the end token alone, and each repeated row is packed."""
    return packing.packed_sequences(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing_stage)]

#: Training, alignment, sketches and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            if last is not None:
                discard(last)
            last = docs
    return docs
