"""Reciprocal rank fusion, parent expansion, compression and limits, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: DataFrame, k: int = 60, id_: str = "chunk_id") -> DataFrame:
    """(qid, id, rrf, rank) from (qid, list_no, rank, id): sum of 1 / (k + rank); ties by first appearance."""
    fused = lists.groupBy("qid", id_).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf"), F.min(F.struct("list_no", "rank")).alias("first"))
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "first", id_))
    return fused.withColumn("rank", r).drop("first")


def fused_top(lists: DataFrame, k: int = 8, rrf_k: int = 60, id_: str = "chunk_id") -> DataFrame:
    """The first 2k fused rows, with score = 100 * rrf to four places."""
    return rrf(lists, rrf_k, id_).where(F.col("rank") <= 2 * k).withColumn("score", F.round(F.col("rrf") * 100, 4))


def expand_to_parents(hits: DataFrame, parents: DataFrame, top: int = 3, k: int = 8) -> DataFrame:
    """(qid, chunk_id, parent_chunk_id, score, is_parent, rank): the parents of the first `top` hits stand for all hits
    of theirs, with the score of the lowest of those hits; then the first 2k by score.

    hits: qid, chunk_id, parent_chunk_id, score, rank. Hits without a parent, or whose parent is not stored, stay."""
    lead = hits.where((F.col("rank") <= top) & F.col("parent_chunk_id").isNotNull())
    chosen = lead.groupBy("qid", "parent_chunk_id").agg(F.min(F.struct(-F.col("rank"), F.col("score").alias("score")))["score"].alias("score"), F.min("rank").alias("rank"))
    stored = chosen.join(parents.select("parent_chunk_id").distinct(), "parent_chunk_id")
    rest = hits.join(stored.select("qid", "parent_chunk_id"), ["qid", "parent_chunk_id"], "left_anti")
    up = stored.select("qid", F.col("parent_chunk_id").alias("chunk_id"), "parent_chunk_id", "score", F.lit(True).alias("is_parent"), F.lit(0).alias("part"), "rank")
    down = rest.select("qid", "chunk_id", "parent_chunk_id", "score", F.lit(False).alias("is_parent"), F.lit(1).alias("part"), "rank")
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "part", "rank", "chunk_id"))
    return up.unionByName(down).withColumn("rank", r).where(F.col("rank") <= 2 * k).drop("part")


def compress(hits: DataFrame, ratio: float = 0.6) -> DataFrame:
    """The best floor(n * ratio) hits of each question, one at least."""
    by = Window.partitionBy("qid")
    r = F.row_number().over(by.orderBy(F.desc("score"), "rank", "chunk_id"))
    kept = hits.withColumn("r", r).withColumn("n", F.count("*").over(by)).where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(ratio))))
    return kept.drop("rank", "n").withColumnRenamed("r", "rank")


def limit(hits: DataFrame, k: int = 8) -> DataFrame:
    return hits.where(F.col("rank") <= k)
