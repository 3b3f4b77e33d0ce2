"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote good, bad or abstain on statistics of the whole text. Expectation-maximisation estimates how often each
rule is right, from the counts of the vote patterns alone (at most 3^7 rows, whatever the input), and a document's
posterior probability of being good replaces the demand that it pass every rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, table

#: Words whose places fit a window's code; a longer text's windows are compared by their words.
MAX_PLACES = 1 << 20
SPACE = "[ \\t-\\r]+"
#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "das", "ist", "nicht", "de", "la", "le", "et", "les", "que", "el", "los", "y", "en", "del")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document goes when it is bad with a probability of over 1 - KEEP_AT.
ROUNDS, KEEP_AT, PRIOR = 25, 0.1, 0.85


def _words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _repeated_words() -> Column:
    """How many words lie in 3-word windows that occur twice or more; from the columns w (words) and n_words.

    Each window is a long: 43 bits of its hash, 20 bits of its place. Sorted, equal windows are neighbours, and equality
    is settled on the words. Where two unequal windows share their 43 bits, or the text has over a million words, the
    windows are compared by their text instead, so the count is exact either way."""
    places = F.sequence(F.lit(0), F.col("n_words") - 3)
    code = lambda i: F.shiftleft(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)), 20).bitwiseOR(i.cast("long"))
    return F.when(F.col("n_words") < 4, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(places, code)))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the rule statistics. Null and empty texts have no words and no lines; nothing else is special."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("w", _words(t)).withColumn("n_words", F.size("w"))
    d = d.withColumn("codes", _repeated_words())
    # neighbours with equal hash bits: (place, place of the one before, equal words?)
    hash_of, place = lambda c: F.shiftright(c, 20), lambda c: c.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
    steps = F.sequence(F.lit(1), F.size("codes") - 1)
    pairs = F.filter(steps, lambda i: hash_of(F.get("codes", i)) == hash_of(F.get("codes", i - 1)))
    d = d.withColumn("twins", F.when(F.size("codes") < 2, F.array().cast("array<int>")).otherwise(pairs))
    same = lambda p, q: (F.get("w", p) == F.get("w", q)) & (F.get("w", p + 1) == F.get("w", q + 1)) & (F.get("w", p + 2) == F.get("w", q + 2))
    clash = F.exists("twins", lambda i: ~same(place(F.get("codes", i)), place(F.get("codes", i - 1)))) | (F.col("n_words") > MAX_PLACES)
    starts = F.array_distinct(F.flatten(F.transform("twins", lambda i: F.array(place(F.get("codes", i)), place(F.get("codes", i - 1))))))
    # the windows themselves in order, where their hashes do not do: a column of its own, so it is sorted once
    window = lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c"), i.alias("i"))
    sorted_ = F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), window))
    d = d.withColumn("exact", F.when(clash & (F.col("n_words") >= 4), sorted_))
    equal = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    twice = F.filter(F.sequence(F.lit(1), F.size("exact") - 1), lambda i: equal(F.get("exact", i), F.get("exact", i - 1)))
    exact = F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(F.get("exact", i)["i"], F.get("exact", i - 1)["i"]))))
    d = d.withColumn("starts", F.sort_array(F.when(F.col("exact").isNotNull(), exact).otherwise(starts)))
    covered = F.aggregate("starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))["n"]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    d = d.withColumn("n_repeat_words", covered).withColumn("lines", lines)
    d = d.withColumn("n_lines", F.size("lines")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long")).withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long"))
    d = d.withColumn("n_function", F.size(F.filter(F.array_distinct("w"), lambda w: w.isin(*FUNCTION_WORDS))))
    d = d.withColumn("n_upper", F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", "")))
    return d.withColumn("n_words", F.col("n_words").cast("long")).drop("w", "codes", "twins", "exact", "starts", "lines")


def votes() -> list[tuple[str, Column]]:
    """(rule, vote): 1 good, -1 bad, 0 abstains."""
    n, share = F.greatest(F.col("n_words"), F.lit(1)), lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean = F.col("word_chars") / n
    return [
        ("symbols", vote(share("n_symbols") < 0.05, share("n_symbols") > 0.1)),
        ("repeats", vote(share("n_repeat_words") < 0.2, share("n_repeat_words") > 0.5)),
        ("lines", vote(F.col("n_dup_lines") * 10 <= F.col("n_lines"), F.col("n_dup_lines") * 10 > F.col("n_lines") * 3)),
        ("capitals", vote(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)) < 0.1, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)) > 0.3)),
        ("function_words", vote(F.col("n_function") >= 2, F.col("n_function") == 0)),
        ("word_length", vote((mean >= 3) & (mean <= 11), (mean < 2) | (mean > 15))),
        ("size", vote(F.col("n_words") >= 2 * MIN_WORDS, F.col("n_words") < MIN_WORDS)),
    ]


def fit(patterns: DataFrame, rules: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, dict[int, float]]]:
    """(log odds of being good, log likelihood ratio by rule and vote) by expectation-maximisation on the pattern counts.

    A rule's accuracy is how often it votes each way on good and on bad documents. The counts of all documents' votes,
    at most 3^len(rules) rows whatever the input, are all that this needs. A rule never counts against its own vote,
    which keeps the two classes from changing places. An empty table leaves the starting values."""
    counts = sorted((tuple(r[x] for x in rules), r["n"]) for r in patterns.collect())
    prior, start = PRIOR, {True: {-1: 0.03, 0: 0.2, 1: 0.77}, False: {-1: 0.35, 0: 0.25, 1: 0.4}}
    rate = {c: [start[c]] * len(rules) for c in start}
    weigh = lambda: [{v: math.log(rate[True][i][v] / rate[False][i][v]) if v == 0 else v * max(0.0, v * math.log(rate[True][i][v] / rate[False][i][v])) for v in (-1, 0, 1)} for i in range(len(rules))]
    for _ in range(rounds if counts else 0):
        weights, mass = weigh(), {True: 0.0, False: 0.0}
        cast = {c: [dict.fromkeys((-1, 0, 1), 1.0) for _ in rules] for c in mass}  # one vote of each kind beforehand
        for v, n in counts:
            p = 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(w[x] for x, w in zip(v, weights, strict=True))))
            for c, share in ((True, p), (False, 1 - p)):
                mass[c] += n * share
                for i, x in enumerate(v):
                    cast[c][i][x] += n * share
        prior = min(max(mass[True] / (mass[True] + mass[False]), 0.5), 0.99)
        rate = {c: [{x: k / sum(votes.values()) for x, k in votes.items()} for votes in cast[c]] for c in cast}
    return math.log(prior / (1 - prior)), dict(zip(rules, weigh(), strict=True))


def posterior(prior: float, weights: dict[str, dict[int, float]]) -> Column:
    """Probability of being good, given the vote columns."""
    odds = F.lit(prior)
    for r, w in weights.items():
        odds = odds + F.when(F.col(r) == 1, w[1]).when(F.col(r) == -1, w[-1]).otherwise(w[0])
    return 1 / (1 + F.exp(-odds))


def _base() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _voted(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    d, rules = features(docs), votes()
    return d.withColumns({r: v for r, v in rules}).withColumn("base_failed", _base()), [r for r, _ in rules]


def _patterns(voted: DataFrame, rules: list[str]) -> DataFrame:
    return stage(voted.groupBy(*rules).agg(F.count("*").alias("n")).coalesce(1), "votes")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and quality (the posterior) for each row; one scan of the texts.

    Null ids stay null and repeated rows repeat. An empty table gives no rows. Columns of docs besides doc_id and text
    are not read."""
    voted, rules = _voted(docs.select("doc_id", "text"))
    held = stage(voted.drop("text"), "quality")
    p = posterior(*fit(_patterns(held, rules), rules))
    out = held.withColumn("quality", F.round(p, 9)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns; two scans of the texts and no shuffle of them."""
    names = docs.columns
    voted, rules = _voted(docs.select("text"))
    p = posterior(*fit(_patterns(voted, rules), rules))
    inner = docs.select(F.struct(*names).alias("row"), F.col("text"))
    voted, rules = _voted(inner)
    # a filter would be pushed below the statistics and hold many copies of them; a generator stays where it is
    kept = voted.withColumn("kept", ~F.col("base_failed") & (F.round(p, 9) >= KEEP_AT))
    return kept.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """judge() over all documents; a null or empty text has no words, fails the base rule and is not kept."""
    return judge(table(spark, sf_dir, "documents"))
