"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases in one pass over each text, and a
shunting-yard parser evaluates the and/or/with expressions behind the tags.

The automaton runs over the text's words (lower-cased, joined by single blanks), so a phrase is found wherever its
words stand consecutively, and over nothing else.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .common import table

#: The base phrases and labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of the method, with labels and weights of evidence.
NOTICES = {
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "bsd license": ("bsd", 0.8),
    "3 clause bsd": ("bsd-3-clause", 0.8),
    "bsd 3 clause": ("bsd-3-clause", 0.8),
    "bsd 2 clause": ("bsd-2-clause", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "isc license": ("isc", 0.8),
    "boost software license": ("bsl", 0.8),
    "cc by": ("cc-by", 0.6),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "cc0": ("cc0", 0.6),
    "creative commons attribution": ("cc-by", 0.7),
    "public domain": ("public-domain", 0.5),
    "all rights reserved": ("proprietary", 0.5),
}
BASE_WEIGHT, TAG_WEIGHT, BROKEN_WEIGHT = 0.8, 0.95, 0.3
TAG = "spdx license identifier"
#: Identifier prefixes, longest first, with labels; True where the family is permissive.
FAMILIES = {
    "mit": ("mit", True), "apache": ("apache", True), "bsd-3": ("bsd-3-clause", True), "bsd-2": ("bsd-2-clause", True), "bsd": ("bsd", True), "isc": ("isc", True), "bsl": ("bsl", True), "cc0": ("cc0", True),
    "cc-by-nc": ("cc-by-nc", False), "cc-by-sa": ("cc-by-sa", False), "cc-by-nd": ("cc-by-nd", False), "cc-by": ("cc-by", True), "lgpl": ("lgpl", False), "agpl": ("agpl", False), "gpl": ("gpl", False), "mpl": ("mpl", False), "epl": ("epl", False),
}
_OTHER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        a.add_word(f" {phrase} ", ("base", phrase, label, BASE_WEIGHT))
    for phrase, (label, weight) in NOTICES.items():
        a.add_word(f" {phrase} ", ("notice", phrase, label, weight))
    a.add_word(f" {TAG} ", ("tag", TAG, "", 0.0))
    a.make_automaton()
    return a


def family(identifier: str) -> tuple[str, bool]:
    """(label, permissive) of a licence identifier; an unknown one is its own label and not permissive."""
    x = identifier.lower().rstrip("+")
    return next((v for k, v in sorted(FAMILIES.items(), key=lambda f: -len(f[0])) if x == k or x.startswith(f"{k}-")), (x, False))


def postfix(tokens: list[str]) -> list[str]:
    """The shunting-yard algorithm: `with` binds closest, then `and`, then `or`. ValueError if malformed."""
    out, held, operand = [], [], True
    for t in tokens:
        low = t.lower()
        if low in _RANK:
            if operand:
                raise ValueError("an operator where a licence belongs")
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif t == "(":
            if not operand:
                raise ValueError("a bracket where an operator belongs")
            held.append(t)
        elif t == ")":
            if operand:
                raise ValueError("an empty bracket")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("a bracket too many")
            held.pop()
        else:
            if not operand:
                raise ValueError("two licences without an operator")
            out.append(t)
            operand = False
    if operand or "(" in held:
        raise ValueError("the expression breaks off")
    return out + held[::-1]


def evaluate(tokens: list[str]) -> tuple[frozenset[str], bool]:
    """(labels, permissive): `or` leaves the choice, `and` binds to both, `with` adds an exception to its left."""
    held: list[tuple[frozenset[str], bool]] = []
    for t in postfix(tokens):
        if t not in _RANK:
            label, free = family(t)
            held.append((frozenset([label]), free))
            continue
        (b, bf), (a, af) = held.pop(), held.pop()
        held.append((a, af) if t == "with" else (a | b, af or bf if t == "or" else af and bf))
    return held[0]


def expression_after(text: str, at: int) -> list[str]:
    """The expression's tokens from `at` to the end of its line, up to the first word that cannot belong to it."""
    out, depth, operand = [], 0, True
    while m := _TOKEN.match(text, at):
        t = m[1].rstrip(".:-") if m[1] not in "()" else m[1]
        if t == ")" and not depth or (t not in "()" and t.lower() not in _RANK and not operand) or (t == "(" and not operand):
            break
        depth += (t == "(") - (t == ")")
        out.append(t)
        operand = t == "(" or t.lower() in _RANK
        if m[1] != t and m[1] not in "()":
            break
        at = m.end()
    while out and (out[-1].lower() in _RANK or out[-1] == "("):
        out.pop()
    return out


_TAG_IN_TEXT = re.compile(r"spdx[^0-9A-Za-z\x80-\U0010ffff]+license[^0-9A-Za-z\x80-\U0010ffff]+identifier[ \t]*:?", re.I | re.A)


def scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple:
    """The result row of one text, without its id."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_OTHER).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    places, evidence, found, tags = [], [], set(), False
    base: set[str] = set()
    at, counted = 0, 0
    for end, (kind, phrase, label, weight) in automaton.iter(line):
        if kind == "tag":
            tags = True
            continue
        start = end - len(phrase) - 1  # of the blank before the phrase
        if kind == "base":
            counted, at = (counted + line.count(" ", at, start), start) if start >= at else (line.count(" ", 0, start), start)
            places.append(counted)
            base.add(label)
        found.add(label)
        evidence.append(weight)
    permissive = None
    if tags:
        for m in _TAG_IN_TEXT.finditer(text):
            tokens = expression_after(text, m.end())
            try:
                labels, free = evaluate(tokens)
            except ValueError:
                evidence.append(BROKEN_WEIGHT)
                continue
            found |= labels
            permissive = free if permissive is None else permissive and free
            evidence.append(TAG_WEIGHT)
    doubt = 1.0
    for w in evidence:
        doubt *= 1 - w
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(found)), round(1 - doubt, 9), permissive


def find(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: base places, labels of both kinds, a score (1 less the product of the evidence's
    doubts) and whether the tagged expressions are permissive (null without any).

    Null and empty texts have no words and score 0. Ids may be null and rows may repeat; other columns are not read."""

    def run(frames):
        automaton = _automaton()
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive"]
        for frame in frames:
            out = pd.DataFrame([scan(t, automaton) for t in frame["text"]], columns=names, dtype=object)
            for c in names[:4]:
                out[c] = out[c].astype("Int64")
            out["score"] = out["score"].astype(float)
            out["permissive"] = out["permissive"].astype("boolean")
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").reset_index(drop=True))
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
