"""Text functions, Column to Column, with the word classes of Unicode wherever words are meant."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def clean_text(c: Column) -> Column:
    """Runs of white space become one blank, control characters go, ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, f"{_WS}+", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{_WS}+", " "))


def truncate(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def file_extension(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"\.([^.]*)$", 1)


def sanitize_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_.\-]", "_"), 1, 200)


def terms(c: Column) -> Column:
    """Distinct words of four characters or more, lower-cased, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{4,})"), F.lit(1)))


def ascii_boundaries(pattern: str) -> str:
    r"""The pattern with \b between word characters of ASCII and all else, as in SQL; Java's counts letters of any script."""
    pattern = re.sub(r"(?<!\\)\\b(?=\w(?![?*{]))", r"(?<!\\w)", pattern)  # beside a word character one look is enough
    pattern = re.sub(r"(?<=[^\\\W])(?<!\\\w)\\b", r"(?!\\w)", pattern)
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def bm25_tokens(c: Column, stopwords=()) -> Column:
    """Tokens of ASCII letters, digits and hyphens that begin with a letter; duplicates stay, stopwords go."""
    ascii_only = F.regexp_replace(F.lower(c), r"[[\p{L}\p{N}]&&[^\x00-\x7F]]", "_")
    found = F.regexp_extract_all(ascii_only, F.lit(r"(\b[a-z][a-z0-9\-]{1,}\b)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def count_hits(c: Column, phrases) -> Column:
    """How many of the phrases are substrings of c."""
    total = F.lit(0)
    for p in phrases:
        total = total + c.contains(p).cast("int")
    return total


def sentences(c: Column) -> Column:
    return F.transform(F.split(c, r"(?<=[.!?])\s+"), strip)


def key_phrases(c: Column, n: int = 3) -> Column:
    """The first n sentences of 4 to 15 words, without their end marks."""
    parts = F.transform(F.split(c, "[.!?]"), strip)
    words = lambda s: F.size(F.split(s, f"{_WS}+"))
    return F.slice(F.filter(parts, lambda s: (s != "") & (words(s) >= 4) & (words(s) <= 15)), 1, n)


def share(part: Column, whole: Column) -> Column:
    """|part and whole| / |whole|, null where whole is empty."""
    return F.when(F.size(whole) > 0, F.size(F.array_intersect(whole, part)) / F.size(whole))


def falsy_to_null(c: Column) -> Column:
    s = c.cast("string")
    return F.when(~s.isin("", "0"), s)
