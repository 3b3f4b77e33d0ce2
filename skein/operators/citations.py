"""Context blocks, prompts, citations and their markers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import falsy_to_null, key_phrases, strip

NO_CONTEXT = "No relevant context retrieved."
INSTRUCTIONS = "Answer the question from the numbered sources below and from nothing else. Cite sources as [N]. Say so when they do not suffice or disagree. Answer in the language of the question.\nContext:\n{context}"


def header(number: Column, filename: Column, doc_type: Column, authors: Column, year: Column, page: Column, section: Column) -> Column:
    part = lambda pre, c, post="": F.concat(F.lit(pre), falsy_to_null(c), F.lit(post))
    return F.concat_ws(" ", F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(filename, F.lit("unknown"))), part("(", doc_type, ")"), part("| ", authors), part("| ", year), part("| p.", page), part("| §", section))


def _in_order(number: Column, value: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(number.alias("n"), value.alias("v")))), lambda x: x["v"]), sep)


def context_blocks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, context) of each question; hits: qid, rank, text, filename, document_type, authors, year, page, section."""
    block = F.concat(header(F.col("rank"), *[F.col(c) for c in ("filename", "document_type", "authors", "year", "page", "section")]), F.lit("\n"), F.col("text"))
    made = hits.groupBy("qid").agg(_in_order(F.col("rank"), block, "\n\n---\n\n").alias("context"))
    return questions.select("qid").join(made, "qid", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def messages(context: Column, question: Column, instructions: str = INSTRUCTIONS) -> Column:
    before, _, after = instructions.partition("{context}")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", F.concat(F.lit(before), context, F.lit(after))), turn("user", question))


def citations(hits: DataFrame) -> DataFrame:
    """One row for each (qid, chunk_id), numbered by its first rank."""
    first = F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("rank"))
    d = hits.withColumn("f", first).where("f = 1").drop("f")
    return d.withColumn("citation_number", F.col("rank")).withColumn("filename", F.coalesce("filename", F.lit("unknown"))).withColumn("score", F.round("score", 4)).withColumn("text_preview", strip(F.substring("text", 1, 250)))


def citation_line() -> Column:
    part = lambda pre, c, post="": F.concat(F.lit(pre), falsy_to_null(F.col(c)), F.lit(post))
    return F.concat_ws(" — ", F.concat(F.lit("["), F.col("citation_number").cast("string"), F.lit("]")), part("", "authors"), F.col("filename"), part("(", "year", ")"), part("*", "journal", "*"), part("p. ", "page"), part("§ ", "section"))


def citation_block(cited: DataFrame) -> DataFrame:
    return cited.groupBy("qid").agg(F.concat(F.lit("\n\n**References:**\n"), _in_order(F.col("citation_number"), citation_line(), "\n")).alias("block"))


def mark(answer: str, phrases: list[list[str]]) -> str:
    """answer with [i] behind the first of the i-th hit's phrases that occurs in it, hit by hit.

    Phrases are literal, backslashes included."""
    for i, candidates in enumerate(phrases, start=1):
        for p in candidates:
            if p.lower() in answer.lower() and f"[{i}]" not in answer:
                answer = re.sub(re.escape(p), lambda _, p=p, i=i: f"{p} [{i}]", answer, count=1, flags=re.I)
                break
    return answer


def inject_markers(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, marked): a fold over each answer's few hits, in Arrow batches of answers."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", key_phrases(F.col("text")).alias("p")))), lambda x: x["p"])
    d = answers.join(hits.groupBy("qid").agg(ordered.alias("phrases")), "qid", "left")

    @F.pandas_udf("string")
    def fold(answer: pd.Series, phrases: pd.Series) -> pd.Series:
        return pd.Series([a if p is None or a is None else mark(a, [list(x) for x in p]) for a, p in zip(answer, phrases, strict=True)], dtype=object)

    return d.select("qid", fold("answer", "phrases").alias("marked"))


SOURCE = ("citation_number", "chunk_id", "document_id", "filename", "page", "section", "score", "rerank_score", "text_preview", "chunk_type", "is_image_chunk", "modality", "caption")


def sources(cited: DataFrame) -> DataFrame:
    """(qid, sources): each question's few citations with what their chunks say of themselves; what is missing is null."""
    one = F.struct(*[F.col(c) if c in cited.columns else F.lit(None).cast("string").alias(c) for c in SOURCE])
    return cited.groupBy("qid").agg(F.sort_array(F.collect_list(one)).alias("sources"))


def kinds(hits: DataFrame) -> DataFrame:
    """(qid, n_hits, text_hits, table_hits, image_hits)."""
    image = F.coalesce(F.col("is_image_chunk"), F.lit(False)) if "is_image_chunk" in hits.columns else F.lit(False)
    table = (F.coalesce(F.col("chunk_type"), F.lit("text")) == "table") & ~image
    return hits.groupBy("qid").agg(F.count("*").alias("n_hits"), F.count_if(~image & ~table).alias("text_hits"), F.count_if(table).alias("table_hits"), F.count_if(image).alias("image_hits"))


def strategy(n_variants: Column, hyde: Column, parents: bool, compression: bool, reranked: bool, multi_query: bool = True) -> Column:
    on = lambda flag, text: F.lit(text) if flag else F.lit(None).cast("string")
    return F.concat_ws(
        " → ", F.lit("Query Enhancement"), F.lit("Embedding"), F.lit("Hybrid Retrieval (dense+sparse, text+table+image)"),
        F.concat(F.lit("Multi-Query("), n_variants.cast("string"), F.lit(")")) if multi_query else F.lit(None).cast("string"), F.when(hyde, "HyDE"), on(parents, "Parent Retrieval"), on(compression, "Compression"),
        on(reranked, "Reranker(BGE+CrossEncoder+Medical)"), F.lit("Context Validation"), F.lit("Prompt Builder"), F.lit("LLM"),
    )
