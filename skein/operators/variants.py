"""Query variants from a generator's raw output, which is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..functions.text import strip


def parse_variants(question: Column, raw: Column, n: int = 3) -> Column:
    """The question and the first n lines of over 10 characters; the question alone if raw is null."""
    lines = F.filter(F.transform(F.split(strip(raw), "\n"), strip), lambda x: F.length(x) > 10)
    return F.concat(F.array(question), F.coalesce(F.slice(lines, 1, n), F.array().cast("array<string>")))


def expand(questions: DataFrame, n: int = 3) -> DataFrame:
    """(qid, variant_no from 0, text) from qid, question and raw_variants."""
    return questions.select("qid", F.posexplode(parse_variants(F.col("question"), F.col("raw_variants"), n)).alias("variant_no", "text"))


VARIANTS_PROMPT = "Write {n} other ways to ask this question, one on each line and nothing else.\nQuestion: {question}"
PASSAGE_PROMPT = "Write a short passage of a textbook that answers this question.\nQuestion: {question}"


def ask(questions: DataFrame, model: providers.Generator, n: int = 3) -> DataFrame:
    """questions with raw_variants and hyde, written by the model where they are missing; null where it fails."""
    prompt = lambda text: F.concat(F.lit(text.partition("{question}")[0]), F.col("question"))
    given = lambda c: F.col(c) if c in questions.columns else F.lit(None).cast("string")
    missing = lambda c, text: F.when(given(c).isNull(), prompt(text))
    made = {"raw_variants": VARIANTS_PROMPT.replace("{n}", str(n)), "hyde": PASSAGE_PROMPT}
    return questions.withColumns({c: F.coalesce(given(c), strip(providers.generate(missing(c, text), model))) for c, text in made.items()})


def answer(questions: DataFrame, contexts: DataFrame, model: providers.Generator, messages) -> DataFrame:
    """questions with `answer`, written by the model from the messages about each question's context where it is missing."""
    given = F.col("answer") if "answer" in questions.columns else F.lit(None).cast("string")
    d = questions.join(contexts.select("qid", "context"), "qid", "left")
    turns = F.array_join(F.transform(messages(F.col("context"), F.col("question")), lambda m: m["content"]), "\n\n")
    return d.withColumn("answer", F.coalesce(given, providers.generate(F.when(given.isNull(), turns), model), F.lit(""))).drop("context")
