"""Incremental ingest: each micro-batch drops what the catalogue holds and appends the rest. An extension of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import new_documents
from ..staging import fresh_path


def write_batch(batch: DataFrame, path: str, by: str = "checksum", order: str = "document_id") -> None:
    """Append the batch's new documents to the table at path.

    The catalogue's checksums are joined by a shuffle or broadcast as their size allows."""
    spark = batch.sparkSession
    try:
        known = spark.read.parquet(path)
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    new_documents(batch, known, by, order).write.mode("append").parquet(path)


def start(stream: DataFrame, path: str, checkpoint: str, order: str = "document_id"):
    """A query that ingests what is there and ends; run again, it goes on behind it."""
    return stream.writeStream.foreachBatch(lambda b, _: write_batch(b, path, order=order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table streamed into a new catalogue."""
    root = fresh_path(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents[.]parquet").select("doc_id", F.sha2("text", 256).alias("checksum"))
    start(stream, f"{root}/catalogue", f"{root}/checkpoint", "doc_id").awaitTermination()
    return spark.read.parquet(f"{root}/catalogue")
