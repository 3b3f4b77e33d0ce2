"""Validation of contexts, verification of claims, calibration of confidence; keyed by qid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import count_hits, sentences, share, terms
from .confidence import clamp

# They must be these for equal results.
NO_HITS = "No context retrieved — answer will be based on model knowledge only."
NO_DOCUMENTS = "No relevant documents found in knowledge base."
LOW_QUALITY = "Retrieved context has low quality scores — results may be unreliable."
LOW_COVERAGE = "Retrieved context may not fully address the question."
CONFLICT = "Conflicting information detected across retrieved sources."
ONE_DOCUMENT = "All context from a single document — consider broader search."
OUTDATED = "Retrieved sources may be outdated (pre-2015)."
SHORT = "Very short context retrieved — answer depth may be limited."
SHORT_GAP = "Insufficient context length for comprehensive answer."
NUMERIC_WARNING, CLAIM_WARNING = "Numeric claim not found in sources: '", "Claim may not be supported by retrieved context: '"


def _unit(score: Column) -> Column:
    return F.when(score > 1, score / 100.0).otherwise(score)


def validate_context(questions: DataFrame, hits: DataFrame, contradictions=L.CONTRADICTIONS) -> DataFrame:
    """quality_score, coverage_score, consistency_score, is_valid, warnings and gaps of each question (qid, question).

    hits: qid, document_id, text, score, year."""
    low = F.lower("text")
    flags = [F.coalesce((F.max(low.rlike(p)) & F.max(low.rlike(n))).cast("int"), F.lit(0)) for p, n in contradictions]
    clashes = sum(flags[1:], flags[0]) if flags else F.lit(0)
    hit_terms = hits.withColumn("t", terms(F.col("text")))
    agg = hit_terms.groupBy("qid").agg(
        F.round(0.5 * F.avg(_unit(F.col("score"))) + 0.5 * F.max(_unit(F.col("score"))), 4).alias("q"),
        F.when(F.count("*") <= 1, 1.0).otherwise(F.round(1.0 - F.least(clashes * 0.1, F.lit(0.5)), 4)).alias("k"),
        F.array_distinct(F.flatten(F.collect_list("t"))).alias("ctx"), F.count_distinct("document_id").alias("docs"),
        F.max(F.coalesce("year", F.lit(0))).alias("newest"), F.sum(F.length("text")).alias("size"),
    )
    d = questions.join(agg, "qid", "left")
    cover = F.coalesce(F.round(share(F.col("ctx"), terms(F.col("question"))), 4), F.lit(0.5))
    none = F.col("q").isNull()
    d = d.withColumns({"quality_score": F.coalesce("q", F.lit(0.0)), "coverage_score": F.when(none, 0.0).otherwise(cover), "consistency_score": F.coalesce("k", F.lit(0.0))})
    weak = F.col("coverage_score") < 0.3
    said = F.array(F.when(F.col("quality_score") < 0.4, LOW_QUALITY), F.when(weak, LOW_COVERAGE), F.when(F.col("consistency_score") < 0.5, CONFLICT), F.when(F.col("docs") == 1, ONE_DOCUMENT), F.when(F.col("newest") < 2015, OUTDATED), F.when(F.col("size") < 200, SHORT))
    gaps = F.array(F.when(weak, F.concat(F.lit("Question terms poorly covered: '"), F.substring("question", 1, 80), F.lit("'"))), F.when(F.col("size") < 200, SHORT_GAP))
    d = d.withColumn("warnings", F.when(none, F.array(F.lit(NO_HITS))).otherwise(F.array_compact(said))).withColumn("gaps", F.when(none, F.array(F.lit(NO_DOCUMENTS))).otherwise(F.array_compact(gaps)))
    return d.withColumn("is_valid", ~none & (F.col("quality_score") >= 0.25) & (F.col("coverage_score") >= 0.15)).drop("q", "k", "ctx", "docs", "newest", "size")


def is_claim(s: Column, numeric=L.NUMERIC_CLAIM, patterns=L.CLAIM_PATTERNS, definitive=L.DEFINITIVE_MARKERS) -> Column:
    stated = (count_hits(F.lower(s), definitive) > 0) & (F.size(F.split(s, r"\s+")) >= 8)
    found = s.rlike(f"(?i){numeric}")
    for p in patterns:
        found = found | s.rlike(f"(?i){p}")
    return (F.length(s) >= 20) & (found | stated)


def extract_claims(answers: DataFrame, most: int = 20, **lexicons) -> DataFrame:
    """(qid, claim_no from 1, claim): the first `most` sentences that claim something."""
    kept = F.slice(F.filter(sentences(F.col("answer")), lambda s: is_claim(s, **lexicons)), 1, most)
    return answers.select("qid", F.posexplode(kept).alias("claim_no", "claim")).withColumn("claim_no", F.col("claim_no") + 1)


def verify_claims(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """claims with is_supported, support_score, supporting (the first three chunk ids) and warning.

    hits: qid, chunk_id, text, rank. Claims meet the hits of their own question alone."""
    c = claims.withColumn("ct", terms(F.col("claim"))).withColumn("nums", F.regexp_extract_all("claim", F.lit(r"(\b\d+(?:\.\d+)?\b)"), F.lit(1)))
    h = hits.select("qid", "chunk_id", "rank", "text", terms(F.col("text")).alias("ht"))
    j = c.join(h, "qid", "left")
    over = F.when(F.size("ht") > 0, F.coalesce(share(F.col("ht"), F.col("ct")), F.lit(0.0)))
    j = j.withColumn("o", over).withColumn("seen", F.exists("nums", lambda n: F.col("text").contains(n)))
    helps = F.col("o") > 0.35
    agg = j.groupBy("qid", "claim_no").agg(
        F.first("claim").alias("claim"), F.first(F.size("nums") > 0).alias("numeric"), F.coalesce(F.max(F.when(helps, F.col("o"))), F.lit(0.0)).alias("best"), F.coalesce(F.max("seen"), F.lit(False)).alias("seen"),
        F.slice(F.transform(F.sort_array(F.collect_list(F.when(helps, F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"]), 1, 3).alias("supporting"),
    )
    agg = agg.withColumn("best", F.when(F.col("numeric") & ~F.col("seen"), F.col("best") * 0.5).otherwise(F.col("best")))
    ok = F.col("best") >= 0.35
    text = F.concat(F.when(F.col("numeric"), NUMERIC_WARNING).otherwise(CLAIM_WARNING), F.substring("claim", 1, 100), F.lit("'"))
    return agg.select("qid", "claim_no", F.substring("claim", 1, 200).alias("claim"), ok.alias("is_supported"), F.round("best", 4).alias("support_score"), "supporting", F.when(~ok, text).alias("warning"))


def evidence(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """support_ratio, evidence_strength, n_claims, n_unsupported and claim_warnings of each answer; no claims: 1.0, moderate."""
    agg = verified.groupBy("qid").agg(F.avg(F.col("is_supported").cast("int")).alias("r"), F.count("*").alias("n_claims"), F.sum((~F.col("is_supported")).cast("long")).alias("n_unsupported"), F.transform(F.sort_array(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("claim_no", "warning")))), lambda x: x["warning"]).alias("claim_warnings"))
    r = F.col("r")
    strength = F.when(r.isNull(), "moderate").when(r >= 0.85, "strong").when(r >= 0.65, "moderate").when(r >= 0.40, "weak").otherwise("insufficient")
    d = answers.select("qid").join(agg, "qid", "left")
    return d.select("qid", F.coalesce(F.round(r, 4), F.lit(1.0)).alias("support_ratio"), strength.alias("evidence_strength"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("n_unsupported", F.lit(0)).alias("n_unsupported"), F.coalesce("claim_warnings", F.array().cast("array<string>")).alias("claim_warnings"))


def unsupported(verified: DataFrame) -> DataFrame:
    return verified.where(~F.col("is_supported")).select("qid", "claim_no", "claim", "warning")


def calibrate(base: DataFrame, context: DataFrame, found: DataFrame, threshold: float = 0.55) -> DataFrame:
    """base (from `confidence`) with overall, hallucination_risk, is_reliable and warnings recomputed."""
    c = context.select("qid", "quality_score", "is_valid", F.col("warnings").alias("cw"))
    d = base.join(c, "qid").join(found, "qid")
    raw = F.col("overall") * 0.65 + F.col("quality_score") * 0.15 + F.col("support_ratio") * 0.20
    raw = F.when(F.col("is_valid"), raw).otherwise(raw * 0.7)
    raw = raw - F.when(F.col("evidence_strength") == "insufficient", 0.25).when(F.col("evidence_strength") == "weak", 0.10).otherwise(0.0)
    n, s = F.col("n_unsupported"), F.col("evidence_strength")
    more = F.array(F.when(n > 0, F.concat(n.cast("string"), F.lit(" claim(s) could not be verified in retrieved sources."))), F.when(s.isin("weak", "insufficient"), F.concat(F.lit("Evidence strength: "), s, F.lit(". Cross-check with primary medical sources recommended."))))
    risk = F.when(n > 0, F.round(F.least(F.col("hallucination_risk") + F.least(n * 0.08, F.lit(0.3)), F.lit(1.0)), 4)).otherwise(F.col("hallucination_risk"))
    d = d.withColumns({"overall": F.round(clamp(raw), 4), "hallucination_risk": risk, "warnings": F.array_distinct(F.concat("warnings", "cw", F.array_compact(more)))})
    return d.withColumn("is_reliable", F.col("overall") >= threshold).drop("cw")
