"""Line dedup by an exact set-similarity join: tokens ordered by rarity, prefix, positional and length filters, a parity
bitmap, and verification of Jaccard on the lines' own words. A line goes when an earlier one matches it.

Lines with equal token sets are one class, which its first line stands for; only classes are joined. A class needs one
earlier match, so a first round offers each prefix token's few nearest earlier candidates; classes that had more
candidates and found no match are offered all of theirs in a second round. So thousands of near copies of a line cost
rows in proportion to their number, and nothing is dropped. Tokens in very many prefixes are dealt out in blocks.

Classes are told apart by a hash of 64 bits, the size and a parity bitmap of 128 bits of the token set; matches are
verified on the words.

Words are cut and hashed for many texts at once, in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, keyed, small, stage, table
from .shingles import U64, hash_words, mix, words_of

PERCENT, NEAREST, BLOCK_ROWS = 80, 2, 50_000
#: log2 of the cells of the table of rarity classes (8 MB), and of the slices it is collected in.
CELL_BITS, SLICE_BITS = 23, 5
#: Characters of the texts that are cut at once, and distinct words that a counting task holds.
CHARS, HELD = 150_000, 1_000_000
#: Rows of token groups that are joined at once.
BATCH_ROWS = 200_000

def need(a, b, percent: int):
    """The overlap that sets of a and b tokens need."""
    return -(-percent * (a + b) // (100 + percent))


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of each word of the texts, lines counted on from text to text."""
    data = "\n".join(texts).encode("utf-8", "surrogatepass")
    h, first, _ = hash_words(data)
    return h, np.searchsorted(np.nonzero(np.frombuffer(data, dtype=np.uint8) == 10)[0], first)


def pieces(texts: list[str | None]):
    """(from, to) of runs of texts with about CHARS characters."""
    lo, size = 0, 0
    for hi, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= CHARS or hi == len(texts):
            yield lo, hi
            lo, size = hi, 0


def count_hashes(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences of each word's hash in all texts. Task-wise counts are handed on as they fill."""

    def run(batches):
        words, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            word, at = np.unique(np.concatenate([np.zeros(0, dtype=U64), *words]), return_inverse=True)
            return word, np.bincount(at, weights=np.concatenate([np.zeros(0, dtype=np.int64), *counts]), minlength=len(word)).astype(np.int64)

        def out(word: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "c"])

        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for lo, hi in pieces(texts):
                w, c = np.unique(hashes(texts[lo:hi])[0], return_counts=True)
                words.append(w)
                counts.append(c)
                held += len(w)
                if held > HELD:
                    word, count = merged()
                    words, counts, held = [word], [count], len(word)
                    if held > HELD // 2:
                        yield out(word, count)
                        words, counts, held = [], [], 0
        yield out(*merged())

    # tasks have counted theirs: no second count before the shuffle
    return docs.select("text").mapInArrow(run, "word long, c long").repartition("word").groupBy("word").agg(F.sum("c").alias("c"))


def level(count):
    """The rarity class of a count: eight to each doubling."""
    return np.minimum(np.round(8 * np.log2(np.maximum(count, 1))), 255).astype(np.uint8)


def levels(words: DataFrame) -> np.ndarray:
    """The rarity class of each cell of word hashes (their first CELL_BITS bits), from the sum of the cell's counts.

    The table has the same size whatever the input; it is collected in slices. Words that share a cell look more
    frequent than they are, which changes the order of tokens, the same for all lines, and no result."""
    cells, n = 1 << CELL_BITS, 1 << (CELL_BITS - SLICE_BITS)

    def run(batches, bits=CELL_BITS):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at, c = (batch.column(0).to_numpy().view(U64) >> U64(64 - bits)).astype(np.int64), batch.column(1).to_numpy()
            for k in np.unique(at // n).tolist():
                some = at // n == k
                held.setdefault(k, np.zeros(n))
                np.add.at(held[k], at[some] % n, c[some])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.int64()), pa.array([level(v).tobytes() for v in held.values()])], ["k", "levels"])

    out = np.zeros(cells, dtype=np.uint8)
    for r in words.select("word", "c").repartition(1 << SLICE_BITS, F.shiftrightunsigned("word", 64 - SLICE_BITS)).mapInArrow(run, "k long, levels binary").collect():
        out[r["k"] * n : (r["k"] + 1) * n] = np.frombuffer(r["levels"], dtype=np.uint8)
    return out


def token(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Word hashes as longs that sort by rarity class, then by hash."""
    return at.astype(np.int64) << 54 | (h >> U64(10)).astype(np.int64)


def lines_of(docs: DataFrame, rarity, percent: int) -> DataFrame:
    """A row for each line with a word: its place, class, size, bitmap and prefix."""

    def run(batches, shift=64 - CELL_BITS):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in pieces(texts):
                h, line = hashes(texts[lo:hi])
                if not len(h):
                    continue
                begin = np.cumsum([0] + [t.count("\n") + 1 for t in texts[lo:hi]])
                key = token(rarity.value[(h >> U64(shift)).astype(np.int64)], h)
                order = np.argsort(key)
                near = line[order].astype(np.uint16 if line[-1] < 1 << 16 else np.int64)
                order = order[np.argsort(near, kind="stable")]
                line, key = line[order], key[order]
                new = np.concatenate([[True], (line[1:] != line[:-1]) | (key[1:] != key[:-1])])
                line, key = line[new], key[new]
                starts = np.nonzero(np.concatenate([[True], line[1:] != line[:-1]]))[0]
                n = np.diff(np.append(starts, len(line)))
                m = mix(key.astype(U64))
                cls = mix(np.add.reduceat(m, starts) + n.astype(U64)).astype(np.int64)
                bit = m >> U64(57)
                one = U64(1) << (bit & U64(63))
                b1, b2 = (np.bitwise_xor.reduceat(np.where((bit >> U64(6)) == half, one, U64(0)), starts).astype(np.int64) for half in (U64(0), U64(1)))
                size = n + 1 - (-(-percent * n // 100))
                ends = np.cumsum(size)
                prefix = key[np.repeat(starts - (ends - size), size) + np.arange(ends[-1])]
                of = np.searchsorted(begin, line[starts], side="right") - 1
                rows = pa.array(of + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(KEY).take(rows),
                        batch.column("doc_id").take(rows),
                        pa.array((line[starts] - begin[of]).astype(np.int32)),
                        pa.array(cls),
                        pa.array(n.astype(np.int32)),
                        pa.array(b1),
                        pa.array(b2),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(prefix)),
                    ],
                    [KEY, "doc_id", "line_no", "class", "n", "b1", "b2", "prefix"],
                )

    return docs.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{KEY} long, doc_id long, line_no int, class long, n int, b1 long, b2 long, prefix array<long>")


#: Places in their order: by doc_id (nulls last), then row, then line.
PLACE = ["none", "doc_id", KEY, "line_no"]


def candidates(rows: DataFrame, percent: int, most: int | None) -> DataFrame:
    """(x, xl, y, yl, more): for each wanted row, places (rank, line) of earlier rows of its token group that pass the
    filters, at most `most` of each token; more says that there may be others.

    rows: task, token, at, line_no, size (n in the upper half, the token's place in the lower), b1, b2 and, unless all
    are, wanted."""

    def pairs(rows: pa.Table):
        order = np.lexsort([rows.column(c).to_numpy() for c in ("line_no", "at", "task", "token")])
        rows = rows.take(pa.array(order))
        task, token = rows.column("task").to_numpy(), rows.column("token").to_numpy()
        run = np.concatenate([[True], (task[1:] != task[:-1]) | (token[1:] != token[:-1])])
        alone = run & np.append(run[1:], True)
        run = run[~alone]
        if not len(run):
            return
        f = {c: rows.column(c).to_numpy(zero_copy_only=False)[~alone] for c in rows.column_names[2:]}
        f["n"], f["pos"] = f["size"] >> 32, f["size"] & 0xFFFFFFFF
        before = np.arange(len(run)) - np.maximum.accumulate(np.where(run, np.arange(len(run)), 0))
        i, d = np.nonzero((before > 0) & f["wanted"] if "wanted" in f else before > 0)[0], 1
        given = np.zeros(len(run), dtype=np.int32)
        while len(i):
            j = i - d
            a, b = f["n"][i], f["n"][j]
            least = need(a, b, percent)
            fits = (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (np.minimum(a - f["pos"][i], b - f["pos"][j]) >= least)
            k = np.nonzero(fits)[0]
            apart = np.bitwise_count((f["b1"][i[k]] ^ f["b1"][j[k]]).astype(U64)).astype(np.int64) + np.bitwise_count((f["b2"][i[k]] ^ f["b2"][j[k]]).astype(U64))
            k = k[apart <= a[k] + b[k] - 2 * least[k]]
            d += 1
            given[i[k]] += 1
            rest = before[i] >= d
            full = given[i] >= most if most else np.zeros(len(i), dtype=bool)
            if len(k):
                x, y = i[k], j[k]
                out = [f["at"][x], f["line_no"][x], f["at"][y], f["line_no"][y], (full & rest)[k]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["x", "xl", "y", "yl", "more"])
            i = i[rest & ~full]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BATCH_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            token = rows.column("token").to_numpy()
            # rows are sorted by token: the last group may go on in the next batch
            cut = int(np.searchsorted(token, token[-1]))
            if cut:
                yield from pairs(rows.slice(0, cut))
            # a group that goes on is looked at again when it has doubled
            rest = rows.slice(cut)
            held, size = rest.to_batches(), 0 if cut else -rest.num_rows
        if held:
            yield from pairs(pa.Table.from_batches(held))

    # sorted by one number, which needs no comparisons of rows; the rest of the order is made batch by batch
    held = rows.repartition("task", "token").sortWithinPartitions("token")
    found = held.mapInArrow(run, "x long, xl int, y long, yl int, more boolean")
    return found.groupBy("x", "xl", "y", "yl").agg(F.max("more").alias("more"))


def verified(pairs: DataFrame, docs: DataFrame, ranks: DataFrame, percent: int) -> DataFrame:
    """(x, xl, same, more) of the pairs' places x, xl: whether a pair's words have the Jaccard similarity."""
    places = pairs.select(F.col("x").alias("at"), F.col("xl").alias("line_no")).union(pairs.select("y", "yl")).distinct()
    places = small(stage(places.join(small(ranks), "at"), "places"))
    some = docs.join(small(stage(places.select(KEY).distinct(), "texts")), KEY, "left_semi")
    texts = some.select(KEY, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).join(places, [KEY, "line_no"])
    texts = stage(texts.select("at", "line_no", "line"), "texts")

    def run(frames):
        for frame in frames:
            same = []
            for a, b in zip(frame["xt"], frame["yt"], strict=True):
                s, t = set(words_of(a)), set(words_of(b))
                both = len(s & t)
                same.append(100 * both >= percent * (len(s) + len(t) - both))
            yield frame[["x", "xl", "more"]].assign(same=same)

    named = [texts.toDF(k, k + "l", k + "t") for k in "xy"]
    joined = pairs.join(named[0], ["x", "xl"]).join(named[1], ["y", "yl"])
    return stage(joined.select("x", "xl", "more", "xt", "yt").mapInPandas(run, "x long, xl int, more boolean, same boolean").groupBy("x", "xl").agg(F.max("same").alias("same"), F.max("more").alias("more")), "verified")


def ranked(rows: DataFrame) -> DataFrame:
    """(row key, at): ranks of the rows by doc_id (nulls last), then row; with gaps."""
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col(KEY)]
    # a lost task sorts the same rows again, and the staged table settles the ranks
    return stage(rows.select(KEY, "doc_id").repartitionByRange(*order).sortWithinPartitions(*order).select(KEY, F.monotonically_increasing_id().alias("at")), "ranks")


def find(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows with their key, (row key, n, gone): lines with words of each row that has any, and numbers of those that go).

    Order is by doc_id (nulls last), then row, then line. Tokens are words between ASCII white space, A-Z lower-cased;
    lines without words, null and empty texts have none and nothing goes from them. Repeated rows repeat each other's
    lines, so all but the first lose theirs. Other columns are not read."""
    rows = keyed(docs.select("doc_id", "text"))
    rarity = levels(stage(count_hashes(rows), "words"))
    lines = stage(lines_of(rows, docs.sparkSession.sparkContext.broadcast(rarity), percent), "lines", "snappy")
    firsts = lines.withColumn("none", F.col("doc_id").isNull()).groupBy("class", "n", "b1", "b2").agg(F.min(F.struct(*PLACE, "prefix")).alias("f"))
    classes = stage(firsts.select("f.*", "n", "b1", "b2"), "classes", "snappy")
    ranks = ranked(rows)
    size = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("size")
    held = classes.join(small(ranks), KEY)
    spread = held.select("at", "line_no", "n", "b1", "b2", F.posexplode("prefix").alias("pos", "token")).select("token", "at", "line_no", size, "b1", "b2")
    # a token in so many prefixes occurs as often in the corpus: only tokens of such a rarity class are counted
    seldom = int(level(BLOCK_ROWS)) << 54
    large = stage(spread.where(F.col("token") >= seldom).groupBy("token").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1"), "large")
    spread = spread.join(small(large), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("at", "line_no"), F.col("blocks")).cast("int")
    spread = spread.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("task", F.least("block", "other") * 65_536 + F.greatest("block", "other"))
    spread = spread.select("task", "token", "at", "line_no", "size", "b1", "b2")
    first = verified(stage(candidates(spread, percent, NEAREST), "near"), rows, ranks, percent)
    place = [F.col("x").alias("at"), F.col("xl").alias("line_no")]
    again = stage(first.where("more and not same").select(*place, F.lit(True).alias("w")), "again")
    # only groups that hold a class in want: their tokens are few
    tokens = stage(held.join(small(again), ["at", "line_no"]).select(F.explode("prefix").alias("token")).distinct(), "tokens")
    rest = spread.join(small(tokens), "token", "left_semi").join(small(again), ["at", "line_no"], "left")
    rest = rest.select("task", "token", "at", "line_no", "size", "b1", "b2", F.coalesce("w", F.lit(False)).alias("wanted"))
    second = verified(stage(candidates(rest, percent, None), "all"), rows, ranks, percent)
    gone = stage(first.where("same").select(*place).union(second.where("same").select(*place)).distinct().join(small(ranks), "at").select(KEY, "line_no"), "matched")
    lead = classes.select(KEY, "line_no").join(gone, [KEY, "line_no"], "left_anti")
    marks = lines.select(KEY, "line_no", F.lit(False).alias("leads")).union(lead.select(KEY, "line_no", F.lit(True)))
    all_, kept = (F.collect_list(F.when(x, F.col("line_no"))) for x in (~F.col("leads"), F.col("leads")))
    return rows, marks.groupBy(KEY).agg(all_.alias("all"), kept.alias("kept")).select(KEY, F.size("all").cast("long").alias("n"), F.sort_array(F.array_except("all", "kept")).alias("gone"))


def report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines (with words), n_removed and removed_lines (numbers from 0, comma-joined) of each row."""
    rows, by = find(docs, percent)
    out = rows.select(KEY, "doc_id").join(by, KEY, "left")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_lines"), removed.alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed_lines"))


def clean(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) with the matched lines taken out; a null text stays null."""
    rows, by = find(docs, percent)
    gone = by.where(F.size("gone") > 0).select(KEY, F.col("gone").alias("l"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("l", i)), "\n")
    return rows.join(gone, KEY, "left").select("doc_id", F.when(F.col("l").isNull(), F.col("text")).otherwise(kept).alias("text"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """report() over all documents; null and empty texts have no lines."""
    return report(table(spark, sf_dir, "documents"))
