"""Reranking: model scores, when there are any, averaged and lifted by lexical evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import count_hits, terms


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def domain_score(text: Column, query: Column, section: Column, doc_type: Column, priority=L.PRIORITY_TERMS, negative=L.NEGATIVE_TERMS, sections=L.VALUED_SECTIONS, types=L.VALUED_TYPES) -> Column:
    low, q = F.lower(text), terms(query)
    hits = F.least(count_hits(low, priority) * 0.03, F.lit(0.15))
    in_section = F.when(F.lower(section).isin(*sections), 0.05).otherwise(0.0)
    of_type = F.when(doc_type.isin(*types), 0.05).otherwise(0.0)
    size = F.least(F.length(text) / 1000.0, F.lit(1.0)) * 0.03
    overlap = F.size(F.array_intersect(q, terms(text))) / F.greatest(F.size(q), F.lit(1)) * 0.1
    score = hits + in_section + of_type + size + overlap - count_hits(low, negative) * 0.05
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(0.3)), 6)


def base_score(score: Column, bge: Column | None = None, ce: Column | None = None) -> Column:
    """Both models: their mean; one: its score; none: score / 100. A model that gave no score counts 0."""
    if bge is not None and ce is not None:
        return F.round(0.5 * F.coalesce(bge, F.lit(0.0)) + 0.5 * F.coalesce(ce, F.lit(0.0)), 6)
    one = bge if bge is not None else ce
    return F.coalesce(one, F.lit(0.0)) if one is not None else score / 100.0


def rerank(hits: DataFrame, top_n: int = 5, bge: str | None = None, ce: str | None = None, domain: bool = True, **lexicons) -> DataFrame:
    """The first top_n of each question by rerank_score; ties keep the order of `rank`.

    hits: qid, question, chunk_id, text, section, document_type, score, rank and the models' columns."""
    base = base_score(F.col("score"), F.col(bge) if bge else None, F.col(ce) if ce else None)
    if domain:
        base = F.round(F.least(base + domain_score(F.col("text"), F.col("question"), F.col("section"), F.col("document_type"), **lexicons), F.lit(1.0)), 6)
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank", "chunk_id"))
    return hits.withColumn("rerank_score", base).withColumn("new_rank", r).where(F.col("new_rank") <= top_n).drop("rank").withColumnRenamed("new_rank", "rank")
