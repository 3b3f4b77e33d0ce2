"""Metadata of documents from their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import strip


def document_type(c: Column, types=L.DOCUMENT_TYPES, at_least: int = 2) -> Column:
    """The type of which most patterns occur, the first of those that tie; `general` below `at_least`."""
    low = F.lower(c)
    scores = [F.struct(reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in ps]).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, ps) in enumerate(types.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] >= at_least, best["t"]).otherwise("general")


def specialty(c: Column, names=L.SPECIALTIES) -> Column:
    low = F.lower(c)
    return F.coalesce(*[F.when(low.contains(n), F.lit(n)) for n in names])


def _first_match(c: Column, patterns, prefix: str = "") -> Column:
    found = [F.regexp_extract(c, prefix + p, 1) for p in patterns]
    return F.coalesce(*[F.when(x != "", strip(x)) for x in found])


def authors(c: Column, patterns=L.AUTHOR_PATTERNS) -> Column:
    return _first_match(F.substring(c, 1, 2000), patterns, "(?dm)")


def journal(c: Column, patterns=L.JOURNAL_PATTERNS) -> Column:
    return _first_match(F.substring(c, 1, 3000), patterns)


def year(c: Column) -> Column:
    return F.regexp_extract(F.substring(c, 1, 3000), r"\b(19[5-9]\d|20[0-2]\d)\b", 1).try_cast("int")


def any_year(c: Column) -> Column:
    return F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def detect_section(line: Column, names=L.SECTION_NAMES) -> Column:
    low = F.lower(strip(line))
    return F.coalesce(*[F.when(low.rlike(f"^(?:{p})$"), F.lit(n)) for n, p in names.items()])


def describe(c: Column, filename: Column) -> Column:
    """A struct of all metadata; the file name is also the source."""
    return F.struct(document_type(c).alias("document_type"), specialty(c).alias("specialty"), year(c).alias("year"), authors(c).alias("authors"), journal(c).alias("journal"), filename.alias("filename"), filename.alias("source"))
