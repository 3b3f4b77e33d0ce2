"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, mixing, sharding.

Each stage works on all rows that the one before kept; run() writes each stage's result to the shared folder. Slots of
a shard are numbered in the mixed order, so the first slots of all shards follow the target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, jaccard, mixing, quality, sharding
from skein.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the quality rules reject; null, empty and blank texts are among those."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of docs that link; of ties in doc_id one row stays, and null ids stay last."""
    return jaccard.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that hold a benchmark item; null and blank items lie in none."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs in mixed order."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, texts included, with their shard and their slot in it, in the order of docs."""
    return sharding.shard_in_order(docs)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", benchmark_passages), ("mixing", mixed_sources), ("sharding", shards)]
#: Estimated accuracies, signatures and the ring's hash have no SQL form; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
