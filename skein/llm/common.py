"""What the training-data operators share: reading, row keys, staged tables, components."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import fresh_path, stage

__all__ = ["fresh_path", "stage"]

#: Rows up to which a two- or three-column key table is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes up to which a table with strings is broadcast.
BROADCAST_BYTES = 48 << 20
KEY, FILE, ROW = "__row_key", "__file", "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame) -> DataFrame:
    """df with a column that names each row, repeated rows included, and is the same on every scan.

    Rows of files are named by file and position. Other frames are staged first, as a key made up on the fly could
    differ when a lost task is run again. A column of that name gives way."""
    df = clashing(df, KEY)
    try:
        out = df.withColumn(KEY, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
        out.schema  # noqa: B018  analysis happens here
        return out
    except AnalysisException:
        return stage(df, "rows").withColumn(KEY, F.xxhash64("_metadata.file_path", "_metadata.row_index"))


def in_place(df: DataFrame) -> DataFrame:
    """df with FILE and ROW, each row's place in the staged table: parts by name, then rows by position.

    Other frames are staged first, in the order of their partitions."""
    place = {FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")}
    try:
        out = df.withColumns(place)
        out.schema  # noqa: B018  analysis happens here
        return out
    except AnalysisException:
        return stage(df, "rows").withColumns(place)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a staged key table of at most `limit` rows; a larger one stays as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def light(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a staged table whose rows, strings and all, take at most `limit` bytes; a larger one stays
    as it is, for a shuffled join."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    row = sum((s.cast("long") for s in strings), F.lit(16 * len(df.columns)).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= limit else df


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """df without extra columns named like what an operator adds."""
    return df.drop(*[c for c in df.columns if c in names])


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long), root being the smallest node of its component.

    Alternates the large-star and small-star steps until the edges form stars, which is when each edge's larger node has
    this edge alone and its smaller node is no larger node of another; each round is a staged table. Rounds grow with
    the logarithm of a component's width; should `rounds` not do, that is an error and no partial result. A node
    with very many neighbours costs no more than its edges: minima are pre-aggregated, and the joins back are
    shuffled equi-joins whose hot keys adaptive execution splits."""
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        e = stage(star, "edges")
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components were not found in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


LONG, STR, DBL, INT, BOOL, BIN = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.BinaryType()
