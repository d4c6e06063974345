"""The queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, hard_negatives, impact_index, licenses, lines, ordinal, packing, pseudonyms, raking, runs, setsketch, sharding, weak_labels


#: Fixed, so that the query can be compared from run to run; a production run passes a secret key.
QUERY_KEY = b"tessella demonstration key"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(_documents(spark, sf_dir))


def op7_setsketch_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_documents(spark, sf_dir))


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.toxicity_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonym_report(_documents(spark, sf_dir), QUERY_KEY)


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.quality_verdicts(_documents(spark, sf_dir))


def op4_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mixing_report(_documents(spark, sf_dir))


def op8_suffix_automaton_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(" ", s.label, s.start, s.end)), ",")
    return licenses.license_scan(_documents(spark, sf_dir)).withColumn("spans", spans)


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_documents(spark, sf_dir))


def op10_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup_report(_documents(spark, sf_dir))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(runs.planted_periods(_documents(spark, sf_dir)))


def op12_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.moved_labels(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_toxicity": op1_ordinal_toxicity,
    "op2_feistel_pseudonyms": op2_feistel_pseudonyms,
    "op3_weak_supervision": op3_weak_supervision,
    "op4_impact_top_k": op4_impact_top_k,
    "op5_raked_mixture": op5_raked_mixture,
    "op6_differencing_packing": op6_differencing_packing,
    "op7_setsketch_near_dup": op7_setsketch_near_dup,
    "op8_suffix_automaton_licenses": op8_suffix_automaton_licenses,
    "op9_sampled_splitters": op9_sampled_splitters,
    "op10_patience_line_dedup": op10_patience_line_dedup,
    "op11_word_runs": op11_word_runs,
    "op12_ball_tree_negatives": op12_ball_tree_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op4_impact_top_k": impact_index.top_k_sql(),
    "op5_raked_mixture": raking.mixing_sql(),
    "op12_ball_tree_negatives": hard_negatives.negatives_sql(),
}
