"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.llm import centroids, decontaminate, exact_dedup, host_rules, mixing, pii, quality_pu, resampling, sharding, simhash, substring, tokencount, warc
from quirewise.llm.common import table


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_md5")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_quality(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates_below(spark, f"{sf_dir}/documents.parquet")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cube_mix": op1_cube_mix,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_personal_data": op5_personal_data,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_host_rules": op8_host_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash": op10_simhash,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_centroids": op12_centroids,
    "op13_resample": op13_resample,
}

ORACLE: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op4_warc": warc.ORACLE,
    "op8_host_rules": host_rules.ORACLE,
    "op9_substring_dedup": substring.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_centroids": centroids.ORACLE,
}
