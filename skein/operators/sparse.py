"""BM25 as tables: terms (token, df, idf), a one-row stats table (n_docs, avgdl), and weights by document and token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import BOOSTED, STOPWORDS
from ..functions.text import bm25_tokens
from ..staging import stage

#: Rows of the questions' token counts up to which the tokens are broadcast.
BROADCAST_TOKENS = 1_000_000


def token_counts(docs: DataFrame, id_: str, text: str = "text", stopwords=STOPWORDS) -> DataFrame:
    """(id, token, tf, dl). Null texts and texts without tokens have no rows."""
    toks = docs.select(F.col(id_), bm25_tokens(F.col(text), stopwords).alias("t"))
    return toks.select(id_, F.explode("t").alias("token"), F.size("t").alias("dl")).groupBy(id_, "token").agg(F.count("*").alias("tf"), F.first("dl").cast("long").alias("dl"))


#: Stands for a text as a whole among its tokens; no token is empty.
_TEXT = ""


def _terms(frequency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, stats) from (token, df, size), the row of _TEXT counting texts and their tokens."""
    stats = frequency.where(F.col("token") == _TEXT).agg(F.coalesce(F.max("df"), F.lit(0)).alias("n_docs"), (F.coalesce(F.max("size"), F.lit(0)) / F.greatest(F.coalesce(F.max("df"), F.lit(0)), F.lit(1))).alias("avgdl"))
    n = F.col("n_docs")
    terms = frequency.where(F.col("token") != _TEXT).join(F.broadcast(stats)).select("token", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))
    return terms, stats


def fit(docs: DataFrame, id_: str, text: str = "text", stopwords=STOPWORDS) -> tuple[DataFrame, DataFrame]:
    """(terms, stats): one scan of the texts and one partial aggregate by token, staged; stats is one row."""
    toks = docs.select(bm25_tokens(F.coalesce(F.col(text), F.lit("")), stopwords).alias("t"))
    rows = toks.select(F.size("t").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(_TEXT)))).alias("token"))
    return _terms(stage(rows.groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("size")), "terms"))


class Index:
    """What BM25 needs of the texts for a set of questions: one scan of the texts, and only the questions' tokens of it.

    The tokens of the questions are broadcast while there are at most BROADCAST_TOKENS; a larger set is joined by a
    shuffle. The counts are staged, so no later step tokenises again."""

    def __init__(self, docs: DataFrame, id_: str, questions: DataFrame, qid: str, text: str = "text", stopwords=STOPWORDS) -> None:
        self.id, self.qid = id_, qid
        self.asked = stage(token_counts(questions, qid, text, stopwords), "asked")
        wanted = self.asked.select("token").distinct()
        wanted = F.broadcast(wanted) if self.asked.count() <= BROADCAST_TOKENS else wanted
        toks = docs.select(id_, bm25_tokens(F.coalesce(F.col(text), F.lit("")), stopwords).alias("t"))
        rows = toks.select(id_, F.explode(F.concat("t", F.array(F.lit(_TEXT)))).alias("token"), F.size("t").cast("long").alias("dl"))
        rows = rows.join(wanted.union(docs.sparkSession.range(1).select(F.lit(_TEXT))), "token", "left_semi")
        counts = stage(rows.groupBy(id_, "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), "counts")
        self.counts = counts.where(F.col("token") != _TEXT)
        # a text's own row counts once for each text, also where ids repeat
        df = F.sum(F.when(F.col("token") == _TEXT, F.col("tf")).otherwise(1))
        self.terms, self.stats = _terms(counts.groupBy("token").agg(df.alias("df"), F.sum(F.col("dl") * F.when(F.col("token") == _TEXT, F.col("tf")).otherwise(0)).alias("size")))

    def search(self, k: int, boosted=BOOSTED, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        weigh = lambda c: encode(c, self.terms, self.stats, boosted, k1, b)
        return search(weigh(self.asked), weigh(self.counts), self.qid, self.id, k)


def weight(tf: Column, dl: Column, idf: Column, avgdl: Column, token: Column, k1: float = 1.5, b: float = 0.75, boosted=BOOSTED, boost: float = 1.5) -> Column:
    w = idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / F.greatest(avgdl, F.lit(1.0))))
    return w * F.when(token.isin(*boosted), boost).otherwise(1.0) if boosted else w


def encode(counts: DataFrame, terms: DataFrame, stats: DataFrame, boosted=BOOSTED, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """counts with the column w; tokens outside the vocabulary drop out, those without an idf weigh 0.5."""
    joined = counts.join(terms.select("token", "idf"), "token").join(F.broadcast(stats))
    return joined.withColumn("w", weight(F.col("tf"), F.col("dl"), F.coalesce("idf", F.lit(0.5)), F.col("avgdl"), F.col("token"), k1, b, boosted)).drop("idf", "avgdl", "n_docs")


def fallback(docs: DataFrame, id_: str, text: str = "text", stopwords=STOPWORDS, top: int = 64) -> DataFrame:
    """Weights of an unfitted encoder: the `top` most frequent tokens, earlier ones first among equals, by tf / total."""
    toks = docs.select(id_, F.posexplode(bm25_tokens(F.col(text), stopwords)).alias("pos", "token"))
    counts = toks.groupBy(id_, "token").agg(F.count("*").alias("tf"), F.min("pos").alias("at"))
    ranked = counts.withColumn("total", F.sum("tf").over(Window.partitionBy(id_))).withColumn("r", F.row_number().over(Window.partitionBy(id_).orderBy(F.desc("tf"), "at")))
    return ranked.where(F.col("r") <= top).select(id_, "token", (F.col("tf") / F.col("total")).alias("w"))


def update(terms: DataFrame, docs: DataFrame, text: str = "text", stopwords=STOPWORDS) -> DataFrame:
    """Terms with the new documents' tokens added, without an idf: the statistics stay those of the first fit."""
    new = docs.select(F.explode(bm25_tokens(F.col(text), stopwords)).alias("token")).distinct().join(terms, "token", "left_anti")
    return terms.unionByName(new, allowMissingColumns=True)


def search(queries: DataFrame, corpus: DataFrame, qid: str, id_: str, k: int) -> DataFrame:
    """(qid, id, score, rank): top k by dot product of two weight tables. Only documents that share a token.

    The join is an equi-join on the token, so a token's rows meet in one place; sums are pre-aggregated, and the rank
    filter is pushed into the window."""
    q, d = queries.select(qid, "token", F.col("w").alias("qw")), corpus.select(id_, "token", F.col("w").alias("dw"))
    scored = q.join(d, "token").groupBy(qid, id_).agg(F.round(F.sum(F.col("qw") * F.col("dw")), 10).alias("score"))
    r = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), id_))
    return scored.withColumn("rank", r).where(F.col("rank") <= k)
