"""Files to documents: one row for each page or whole file."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedFileTypeError
from ..functions.text import clean_text, file_extension, sanitize_filename

SUPPORTED = ("pdf", "txt", "md")
PAGES = "page int, text string"


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text): a whole UTF-8 file is one row, its text as it is."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.lit(0).alias("page"), F.col("value").alias("text"))


load_markdown = load_text


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, checksum, extension) of files as they are, without reading them on the driver."""
    d = spark.read.format("binaryFile").load(path)
    return d.select("path", "content", F.sha2("content", 256).alias("checksum"), file_extension(F.col("path")).alias("extension"))


def load_pdf(files: DataFrame, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text) of the pages that hold over 20 characters once cleaned; pages_of is the PDF provider.

    A file that the provider cannot read gives no pages."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    pages = pages_of(bytes(content))
                except Exception:  # whatever a parser raises on a broken file
                    pages = []
                rows += [(path, i, p) for i, p in enumerate(pages)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    got = files.select("path", "content").mapInPandas(run, "path string, page int, text string")
    return got.withColumn("text", clean_text(F.col("text"))).where(F.length("text") > 20)


READ = """document_id string, kind string, page int, number int, text string, near_text string, data binary, n_bytes long,
    width int, height int, channels int, words array<struct<x0:double,x1:double,y0:double,text:string>>,
    x0 double, x1 double, y1 double, header array<string>, cells array<array<string>>, error string"""
_FIELDS = [f.split()[0] for f in READ.replace("array<struct<x0:double,x1:double,y0:double,text:string>>", "x").split(",")]


def read_pdf(files: DataFrame, reader) -> DataFrame:
    """One row for each page, picture and table (`kind`) of files (document_id, content), in one pass of the reader.

    A file that the reader cannot read has one row of kind `error`."""

    def rows_of(read, document_id, content):
        try:
            pages = read(bytes(content))
        except Exception as e:  # whatever a parser raises on a broken file
            yield {"kind": "error", "error": f"{type(e).__name__}: {e}"}
            return
        for no, page in enumerate(pages):
            text = page.get("text") or ""
            yield {"kind": "page", "page": no, "text": text}
            words = [{"x0": float(x0), "x1": float(x1), "y0": float(y0), "text": w} for x0, x1, y0, w in page.get("words", ())]
            for i, m in enumerate(page.get("images", ())):
                box = m.get("box")
                at = dict(zip(("x0", "x1", "y1"), map(float, box), strict=True)) if box else {}
                yield {"kind": "image", "page": no + 1, "number": i, "near_text": text, "data": m["data"], "n_bytes": m.get("n_bytes", len(m["data"])), "width": m["width"], "height": m["height"], "channels": m["channels"], "words": words if box else None, **at}
            for i, m in enumerate(page.get("tables", ())):
                cells = [[None if v is None else str(v) for v in r] for r in m["rows"]]
                yield {"kind": "table", "page": no + 1, "number": i, "header": [str(v) for v in m["header"]], "cells": cells}

    def run(frames):
        read = reader.load()
        for frame in frames:
            for document_id, content in zip(frame["document_id"], frame["content"], strict=True):
                found = [[document_id if f == "document_id" else r.get(f) for f in _FIELDS] for r in rows_of(read, document_id, content)]
                made = pd.DataFrame(found, columns=_FIELDS, dtype=object)
                yield made.astype({"page": "Int32", "number": "Int32", "width": "Int32", "height": "Int32", "channels": "Int32", "n_bytes": "Int64"})

    return files.select(F.col("document_id").cast("string").alias("document_id"), "content").mapInPandas(run, READ)


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data) of picture files, decoded in the JVM; data are raw pixels, colours in RGB order.

    Files that cannot be decoded are left out."""
    d = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    @F.pandas_udf("binary")
    def in_order(data: pd.Series, n: pd.Series) -> pd.Series:
        turn = lambda d, c: d if c == 1 else np.ascontiguousarray(np.frombuffer(d, np.uint8).reshape(-1, c)[:, [2, 1, 0, 3][:c]]).tobytes()
        return pd.Series([turn(x, c) for x, c in zip(data, n, strict=True)], dtype=object)

    return d.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), in_order("data", "nChannels").alias("data"))


def spool(files: DataFrame, folder: str) -> DataFrame:
    """Keep files (filename, content) in a table by sanitised name, and return that table.

    An equal name replaces what was there when the table is read: the newest write counts."""
    kept = files.select(sanitize_filename(F.col("filename")).alias("filename"), "content", F.current_timestamp().alias("kept_at"))
    kept.write.mode("append").parquet(folder)
    newest = F.max_by(F.col("content"), F.col("kept_at"))
    return files.sparkSession.read.parquet(folder).groupBy("filename").agg(newest.alias("content"))


def check_extension(name: str) -> str:
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext not in SUPPORTED:
        raise UnsupportedFileTypeError(ext)
    return ext
