"""Confidence in an answer from its hits: one grouped aggregate and a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import count_hits, share, terms


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def retrieval_confidence(score: str = "score", top_k: int = 8) -> Column:
    return F.round(0.4 * F.max(score) + 0.4 * F.avg(score) + 0.2 * F.least(F.count(score) / top_k, F.lit(1.0)), 4)


def answer_grounding(answer: str = "answer", text: str = "text") -> Column:
    """Twice the mean share of a hit's terms that the answer has, 1 at most; hits without terms count as 0."""
    own = F.coalesce(share(terms(F.col(answer)), terms(F.col(text))), F.lit(0.0))
    return F.round(F.least(F.sum(own) / F.count("*") * 2.0, F.lit(1.0)), 4)


def source_coverage(document_id: str = "document_id", section: str = "section") -> Column:
    named = F.when(~F.col(section).isin("", "general"), F.col(section))
    return F.round(0.6 * F.least(F.count_distinct(document_id) / 3.0, F.lit(1.0)) + 0.4 * F.least(F.count_distinct(named) / 4.0, F.lit(1.0)), 4)


def hallucination_risk(answer: Column, avg_score: Column, uncertainty=L.UNCERTAINTY_PHRASES, hedges=L.HEDGE_PHRASES, anchors=L.ANCHOR_PHRASES) -> Column:
    """0.9 without hits (avg_score null)."""
    low = F.lower(answer)
    risk = F.greatest(F.lit(0.0), 0.8 - avg_score) + count_hits(low, uncertainty) * 0.1 + count_hits(low, hedges) * 0.02 - count_hits(low, anchors) * 0.05
    return F.when(avg_score.isNull(), 0.9).otherwise(F.round(clamp(risk), 4))


# They must be these for equal results.
LOW_RETRIEVAL = "Low retrieval confidence — answer may not be well-supported."
LOW_GROUNDING = "Answer may contain information not found in retrieved sources."
HIGH_RISK = "Elevated hallucination risk detected — verify with primary sources."
NO_CONTEXT = "No context retrieved — answer based on model knowledge only."


def confidence(answers: DataFrame, hits: DataFrame, top_k: int = 8, threshold: float = 0.55, risk_threshold: float = 0.4, **lexicons) -> DataFrame:
    """A row for each answer (qid, answer) from its hits (qid, document_id, section, text, score); answers without hits
    keep theirs."""
    joined = hits.join(answers.select("qid", "answer"), "qid")
    agg = joined.groupBy("qid").agg(retrieval_confidence(top_k=top_k).alias("rc"), answer_grounding().alias("ag"), source_coverage().alias("sc"), F.avg("score").alias("avg_score"))
    d = answers.join(agg, "qid", "left")
    d = d.withColumns({"retrieval_confidence": F.coalesce("rc", F.lit(0.0)), "answer_grounding": F.when(F.col("answer") == "", 0.0).otherwise(F.coalesce("ag", F.lit(0.0))), "source_coverage": F.coalesce("sc", F.lit(0.0)), "hallucination_risk": hallucination_risk(F.col("answer"), F.col("avg_score"), **lexicons)})
    overall = 0.35 * F.col("retrieval_confidence") + 0.35 * F.col("answer_grounding") + 0.15 * F.col("source_coverage") + 0.15 * (1.0 - F.col("hallucination_risk"))
    d = d.withColumn("overall", F.round(clamp(overall), 4))
    said = F.array(F.when(F.col("retrieval_confidence") < 0.4, LOW_RETRIEVAL), F.when(F.col("answer_grounding") < 0.3, LOW_GROUNDING), F.when(F.col("hallucination_risk") > risk_threshold, HIGH_RISK), F.when(F.col("avg_score").isNull(), NO_CONTEXT))
    return d.withColumn("is_reliable", F.col("overall") >= threshold).withColumn("warnings", F.array_compact(said)).drop("rc", "ag", "sc", "avg_score")
