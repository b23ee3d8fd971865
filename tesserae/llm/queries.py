"""Registered queries of the text operators over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import elias_fano, jaccard, length_stats, line_rules, mixing, packing, quality_lm, sharding, suffix_dedup, telephony
from tesserae.llm.common import documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), 8)


def op2_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_lm.judge(documents(spark, sf_dir), labels)


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.verdicts(documents(spark, sf_dir))


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digest(telephony.store(documents(spark, sf_dir)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(
        documents(spark, sf_dir), mixing.QUERY_WEIGHTS, mixing.QUERY_PERCENT, mixing.QUERY_EPOCHS, mixing.QUERY_SEED
    )


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), 4, 85)


def op8_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elias_fano.read_documents(elias_fano.write_segments(documents(spark, sf_dir)))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_stats.length_table(length_stats.length_histogram(documents(spark, sf_dir)))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_lm": op2_quality_lm,
    "op3_line_rules": op3_line_rules,
    "op4_telephony": op4_telephony,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_jaccard": op7_jaccard,
    "op8_elias_fano": op8_elias_fano,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
}
ORACLE_QUERIES: dict[str, str] = {
    "op1_sharding": sharding.ORACLE_SQL,
    "op3_line_rules": line_rules.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op7_jaccard": jaccard.ORACLE_SQL,
}
