"""The document catalogue and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checksum(content: str = "content") -> F.Column:
    return F.sha2(F.col(content), 256)


def new_documents(docs: DataFrame, catalogue: DataFrame | None, by: str = "checksum", order: str = "document_id") -> DataFrame:
    """docs that are neither in the catalogue nor repeat an earlier one of the batch.

    The batch is reduced by a pre-aggregated minimum, so a checksum with very many copies is no hot group."""
    first = docs.groupBy(by).agg(F.min(order).alias(order))
    out = docs.join(first, [by, order], "left_semi").dropDuplicates([by])
    return out if catalogue is None else out.join(catalogue.select(by), by, "left_anti")


def count_by_type(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("document_type").agg(F.count("*").alias("n"))


def chunk_type_counts(chunks: DataFrame) -> DataFrame:
    image, table = F.col("is_image_chunk"), F.col("chunk_type") == "table"
    return chunks.agg(F.count_if(F.coalesce(image, F.lit(False))).alias("image"), F.count_if(F.coalesce(table & ~F.coalesce(image, F.lit(False)), F.lit(False))).alias("table"), F.count_if(~F.coalesce(image | table, F.lit(False))).alias("text"))


def stats(catalogue: DataFrame, n_chunks: int) -> DataFrame:
    types = count_by_type(catalogue).agg(F.map_from_entries(F.collect_list(F.struct("document_type", "n"))).alias("document_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"))
    return types.withColumn("total_vectors", F.lit(n_chunks).cast("long"))


def carry_sections(chunks: DataFrame, detected: str = "detected") -> DataFrame:
    """chunks (document_id, pos) with `section`: the last detected one so far, `general` before the first."""
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("section", F.coalesce(F.last(detected, True).over(w), F.lit("general")))
