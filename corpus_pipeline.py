"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; a stage's result is stored as Parquet and read again
before the next one, and what was made on the way to it is deleted. All but the last keep the columns of documents, whatever their names.

Null texts have no words and are rejected by the quality rules. Of rows that tie in a group of near-duplicates any one stays. Rows that
the mix takes twice are rows of their own for the shards. Empty tables give empty results.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from quirewise.llm import decontaminate, host_rules, mixing, sharding, simhash
from quirewise.llm.common import settle, table

#: The mix draws lots and the shards follow hashes, which SQL can't express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or break a soft rule in a host that fails far more often than hosts do, go."""
    return host_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or twice."""
    return mixing.mix(docs)


def balanced_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
    ("sharding", balanced_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(spark, name, functools.partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
