"""Sections, parents and children of documents.

Sections are cut by a sentinel put before each header. Pieces come from one recursive splitter, which runs in Arrow
batches; ids are digests of where a piece stands, so a second run gives the same ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.metadata import detect_section
from ..functions.text import strip

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
_MARK = "\x01"


def sections(text: Column, headers=L.SECTION_HEADERS) -> Column:
    """array<struct<name, text>>: `preamble` before the first header, `general` where there is none; blanks dropped.

    A section's name is the canonical one of its header line, or that line itself, lower-cased; headers of the forms
    `##` and `1. X` are named by what their pattern matches."""
    rule = "(?idm)(" + "|".join(f"(?:{h})" for h in headers) + ")"
    cut = F.split(F.regexp_replace(text, rule, f"{_MARK}$1"), _MARK)
    named = F.transform(cut, lambda part, i: F.struct(F.when(i == 0, "preamble").otherwise(_name(F.regexp_extract(part, rule, 1))).alias("name"), strip(part).alias("text")))
    kept = F.filter(named, lambda s: s["text"] != "")
    return F.when(F.size(cut) == 1, F.filter(F.array(F.struct(F.lit("general").alias("name"), text.alias("text"))), lambda s: strip(s["text"]) != "")).otherwise(kept)


def _name(line: Column) -> Column:
    return F.coalesce(detect_section(line), F.lower(strip(line)))


def split_text(text: str, size: int, overlap: int, separators=SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that occurs, merged greedily; neighbours share up
    to `overlap` characters. Pieces keep their order, and together they hold all that is not white space."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p + sep if i < text.count(sep) else p for i, p in enumerate(text.split(sep))]
    out, held, n = [], [], 0

    def emit() -> None:
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) > size:
            emit()
            held, n = [], 0
            out += split_text(part, size, overlap, rest or ("",))
            continue
        if n + len(part) > size:
            emit()
            while held and (n > overlap or n + len(part) > size):
                n -= len(held.pop(0))
        held.append(part)
        n += len(part)
    emit()
    return out


def split_column(text: Column, size: int, overlap: int) -> Column:
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split_text(t, size, overlap) for t in texts], dtype=object)

    return cut(text)


def chunk(docs: DataFrame, child: tuple[int, int] = (512, 64), parent: tuple[int, int] = (2048, 128)) -> tuple[DataFrame, DataFrame]:
    """(children, parents) of docs (document_id, text, page and whatever metadata)."""
    meta = [c for c in docs.columns if c != "text"]
    s = docs.select(*meta, F.posexplode(sections(F.col("text"))).alias("section_no", "s")).select(*meta, "section_no", F.col("s.name").alias("section"), F.col("s.text").alias("body"))
    p = s.select(*meta, "section_no", "section", F.posexplode(split_column(F.col("body"), *parent)).alias("parent_no", "text"))
    pid = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.coalesce(F.col("page").cast("string"), F.lit("")) if "page" in meta else F.lit(""), "section_no", "parent_no"), 256)
    parents = p.withColumn("parent_chunk_id", pid)
    c = parents.select(*meta, "section", "parent_chunk_id", F.posexplode(split_column(F.col("text"), *child)).alias("child_no", "child"))
    children = c.withColumn("chunk_id", F.sha2(F.concat_ws("|", "parent_chunk_id", F.col("child_no").cast("string")), 256)).withColumnRenamed("child", "text").withColumn("chunk_type", F.lit("text"))
    return children, parents


def markdown(header: Column, cells: Column) -> Column:
    """A pipe table of array<string> and array<array<string>>; a table without rows is blank, a null cell empty."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.transform(header, lambda _: F.lit("---"))
    lines = F.concat(F.array(row(header), row(rule)), F.transform(cells, row))
    return F.when(F.size(cells) > 0, F.array_join(lines, "\n")).otherwise("")


def table_chunks(tables: DataFrame) -> DataFrame:
    """Chunks of tables (document_id, page, table_index, markdown)."""
    text = F.concat(F.lit("[TABLE from page "), F.col("page").cast("string"), F.lit("]\n"), F.col("markdown"))
    return tables.where(strip(F.col("markdown")) != "").select("*", text.alias("text"), F.lit("table").alias("section"), F.lit("table").alias("chunk_type"), F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.lit("table"), "page", "table_index"), 256).alias("chunk_id"))
