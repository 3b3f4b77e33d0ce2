"""Personal data: fixed patterns give seed entities; bootstrapped contexts discover identifiers of other shapes.

The first pass over the texts finds the base spans, which are the seeds, the candidates (words outside any base span with
a digit, or with a mark such as a dot or hyphen between other characters; plain words are none), and the patterns around
both: the two words before, and the word before with the word behind; the borders of a text count as words. Patterns that
hold at least GRAPH_SEEDS different seeds and a candidate make the graph. The second pass counts how often each of them
occurs, around words of whatever shape. Spark scores the graph in rounds: for each kind, a pattern by the share of its
occurrences that hold known instances, an instance by the patterns that hold it. Where patterns that score high hold a
candidate, it is a span of kind `other`, and the best pattern's kind is what it is likely to be.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, small, stage, table
from .shingles import U64, hash_words, mix

KINDS = ("email", "ip", "card", "phone")
ROUNDS, GRAPH_SEEDS, MIN_SEEDS, MIN_SCORE, MIN_LENGTH = 3, 2, 3, 0.6, 3
#: Patterns that one pass over the texts counts; more are counted in further passes.
PATTERNS = 4_000_000
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: An address from its @ on. What stands before it is found from the @ leftwards, so a long word costs nothing.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number can only begin where no digit stands before it: a match that fails there fails at its later digits too.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EDGE = b".:!?*#$%&\"'<>()[]{},;|"
#: Bytes that make a word one that may be an identifier, and texts that may hold one.
_SHAPE = np.zeros(256, dtype=bool)
_SHAPE[list(b"0123456789._-+@/:=")] = True
_MAY = re.compile(r"[0-9._+@/:=-]")
_BEGIN, _END = U64(1), U64(2)


_M = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = []
    end = last_at = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        lo = max(end, last_at)
        start = lo + len(text[lo : m.start()].rstrip(LOCAL))
        last_at = m.start() + 1
        if start < m.start():
            end = m.end()
            out.append(("email", start, end))
    if not any(d in text for d in "0123456789"):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Slots:
    """A text's words as hashes, and the hashes of the patterns around each gap of one word or more."""

    def __init__(self, text: str) -> None:
        self.data = text.encode("utf-8", "surrogatepass")
        self.h, self.first, self.end = hash_words(self.data)
        self.padded = np.concatenate([[_BEGIN, _BEGIN], self.h, [_END]])
        self.ascii = len(self.data) == len(text)
        # code points before each byte
        self.point = None if self.ascii else np.cumsum(np.append(0, (np.frombuffer(self.data, dtype=np.uint8) & 0xC0) != 0x80))

    def patterns(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the gaps from word i to word j: two words before, and one before with one behind."""
        a, b, c = self.padded[i], self.padded[i + 1], self.padded[j + 3]
        return mix(a * _M[0] + b * _M[1] + U64(7)).astype(np.int64), mix(b * _M[0] + c * _M[1] + U64(9)).astype(np.int64)

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points before the bytes."""
        return at if self.ascii else self.point[at]

    def words(self, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each span of code points."""
        a, b = np.array(spans).T
        if not self.ascii:
            a, b = np.searchsorted(self.point, a, side="left"), np.searchsorted(self.point, b, side="left")
        return np.searchsorted(self.end, a, side="right"), np.searchsorted(self.first, b, side="left") - 1

    def candidates(self) -> list[tuple[int, int, int]]:
        """(word, first byte, byte behind it) of the words that may be identifiers, without marks at their ends."""
        data = np.frombuffer(self.data, dtype=np.uint8)
        some = np.cumsum(np.append(0, _SHAPE[data]))
        out = []
        for i in np.nonzero(some[self.end] > some[self.first])[0]:
            word = self.data[self.first[i] : self.end[i]]
            a, b = int(self.first[i]) + len(word) - len(word.lstrip(_EDGE)), int(self.end[i]) - len(word) + len(word.rstrip(_EDGE))
            if b - a >= MIN_LENGTH and some[b] > some[a]:
                out.append((int(i), a, b))
        return out


def instances(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Place, pattern, instance and kind (-1 for a candidate) of base spans and candidates, a row for each pattern."""
    if not spans and not _MAY.search(text):
        return []
    slots = Slots(text)
    taken = np.zeros(len(slots.h) + 1, dtype=bool)
    found = []
    if spans:
        first, last = slots.words([(a, b) for _, a, b in spans])
        for i, j, (kind, a, b) in zip(first, last, spans, strict=True):
            taken[i : j + 1] = True
            found.append((i, j, a, b, KINDS.index(kind)))
    free = [x for x in slots.candidates() if not taken[x[0]]]
    if free:
        at = slots.points(np.array([x[1:] for x in free]))
        found += [(i, i, int(a), int(b), -1) for (i, _, _), (a, b) in zip(free, at, strict=True)]
    if not found:
        return []
    left, both = slots.patterns(np.array([x[0] for x in found]), np.array([x[1] for x in found]))
    return [{"s": a, "e": b, "p": int(p), "i": _long(text[a:b]), "k": k} for ps in (left, both) for p, (_, _, a, b, k) in zip(ps, found, strict=True)]


def _long(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(docs: DataFrame) -> DataFrame:
    """Base results, and the instances with their patterns, of each row, staged."""

    def run(frames):
        for frame in frames:
            rows = []
            for key, doc_id, text in zip(frame[KEY], frame["doc_id"].astype("Int64"), frame["text"], strict=True):
                spans = base_spans(text or "")
                said = written(spans)
                counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                rows.append((key, doc_id, *counts, hashlib.sha256(said.encode()).hexdigest(), said, instances(text or "", spans)))
            yield pd.DataFrame(rows, columns=[KEY, "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "found"], dtype=object).astype({KEY: "int64", "doc_id": "Int64"} | {f"n_{k}": "int64" for k in KINDS})

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return stage(docs.select(KEY, "doc_id", "text").mapInPandas(run, f"{KEY} long, doc_id long, {counts}, base_sha256 string, base string, found array<struct<s:int,e:int,p:long,i:long,k:int>>"), "spans")


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(p, n): how often each of the patterns (p) occurs, staged. A pass takes about PATTERNS of them."""
    spark = docs.sparkSession
    out = patterns.select("p", F.lit(0).cast("long").alias("n"))
    parts = -(-patterns.count() // PATTERNS)
    for part in range(parts):
        some = patterns if parts == 1 else patterns.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast(np.sort(np.array([r["p"] for r in some.collect()], dtype=np.int64)))

        def run(frames, held=held):
            known = held.value
            count = np.zeros(len(known) + 1, dtype=np.int64)
            for frame in frames:
                for text in frame["text"]:
                    slots = Slots(text or "")
                    n = np.arange(len(slots.h))
                    for ps in slots.patterns(n, n):
                        at = np.minimum(np.searchsorted(known, ps), len(known) - 1)
                        np.add.at(count, np.where(known[at] == ps, at, len(known)), 1)
            some = np.nonzero(count[:-1])[0]
            yield pd.DataFrame({"p": known[some], "n": count[some]})

        out = out.union(docs.select("text").mapInPandas(run, "p long, n long"))
    return stage(out.groupBy("p").agg(F.sum("n").alias("n")), "occurrences")


def good_patterns(found: DataFrame, size: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(p, k, score) of the patterns that score MIN_SCORE or more for a kind, from the graph's occurrences (p, i, k) and
    how often each pattern occurs in all (p, n). A pattern that is good for several kinds has a row for each.

    Occurrences are reduced to counted edges first, so a pattern or instance that is everywhere has few rows."""
    edges = stage(found.groupBy("p", "i").agg(F.count("*").alias("times")), "edges")
    sure = stage(found.where("k >= 0").select("i", "k", F.lit(1.0).alias("v")).distinct(), "sure")
    known = sure
    for _ in range(rounds):
        known = stage(known, "known")
        scored = edges.join(known, "i").groupBy("p", "k").agg(F.sum(F.col("v") * F.col("times")).alias("hits"), F.sum("v").alias("kinds")).join(size, "p")
        score = F.col("hits") / (F.greatest("n", "hits") + 1)
        patterns = stage(scored.where(F.col("kinds") >= MIN_SEEDS).select("p", "k", score.alias("score")).where(F.col("score") >= MIN_SCORE), "patterns")
        lifted = edges.join(patterns, "p").groupBy("i", "k").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("v"))
        known = lifted.union(sure).groupBy("i", "k").agg(F.max("v").alias("v"))
    return patterns


def scan(docs: DataFrame) -> DataFrame:
    """Base counts, base_sha256, all spans and the likely kinds of the discovered ones, in their order, of each row;
    spans of kind `other` stand behind the base ones.

    Null and empty texts have no spans. Ids may be null, rows may repeat, an empty table gives no rows, and other columns
    are not read."""
    texts = keyed(docs.select("doc_id", "text"))
    rows = extract(texts)
    found = rows.select(KEY, F.explode("found").alias("x")).select(KEY, "x.*")
    seeded = F.count_distinct(F.when(F.col("k") >= 0, F.col("i")))
    graph = stage(found.groupBy("p").agg(seeded.alias("n"), F.min("k").alias("least")).where((F.col("n") >= GRAPH_SEEDS) & (F.col("least") < 0)).select("p"), "graph")
    places = stage(found.join(small(graph), "p", "left_semi"), "places")
    patterns = good_patterns(places, occurrences(texts, graph))
    places = places.where("k < 0").drop("k")
    best = F.max(F.struct("score", -F.col("k"))).alias("best")
    new = places.join(patterns, "p").groupBy(KEY, "s", "e").agg(best).select(KEY, F.struct("s", "e", (-F.col("best.col2")).alias("k")).alias("x"))
    new = new.groupBy(KEY).agg(F.sort_array(F.collect_list("x")).alias("x"))
    named = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("x", lambda x: F.concat(F.lit("other:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")
    out = rows.drop("found").join(new.select(KEY, spans.alias("more"), F.array_join(F.transform("x", lambda x: F.get(named, x["k"])), ",").alias("likely")), KEY, "left")
    said = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", said.alias("spans"), F.coalesce("likely", F.lit("")).alias("other_kinds"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """scan() over all documents; nulls count as there."""
    return scan(table(spark, sf_dir, "documents"))
