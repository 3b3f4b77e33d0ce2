"""Exact Jaccard join of documents on word shingles, with PartEnum signatures.

Sets are put into size bands; at the level of a band, sets that link differ in at most k shingles. The domain of
shingles is dealt into k / 2 + 1 + e partitions of PARTS parts each. Sets that link differ in one shingle at most on at
least e + 1 of the partitions, and there all parts but one agree: so each subset of PARTS - 1 parts is enumerated as a
signature. Partitions in which a subset holds fewest shingles say least: such subsets are left out, of up to e
partitions. That loses nothing: subsets that agree hold equally many, so of e + 1 at least one is left in for both sets.
A set has signatures at its own level and the next.

Sets that share a signature, and whose parity bitmaps differ in no more bits than sets that link may differ in shingles,
fall into one blob (a component of that graph). The bitmap keeps passages that many documents share from joining them. Blobs are verified in tasks of
bounded size: within a task a pair is compared only if it shares a signature and is not linked already, and what comes
out is a spanning forest, never all pairs. Components of those links are the classes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, components, keyed, small, stage, table
from .shingles import U64, mix, text_sets

#: Bytes of text and texts in one side of a verification task.
BLOCK_BYTES, BLOCK_TEXTS = 4_000_000, 700
#: Words of 64 bits in a parity bitmap, and the rows of a signature that are compared shift by shift.
BITMAP, SHORT = 8, 32
#: Bytes of the classes' sizes and bitmaps up to which they are broadcast.
FACTS_BYTES = 48_000_000
#: Parts of a partition, and e as a share of k.
PARTS, SPARE = 3, 0.05
_LEFT, _RIGHT = (np.array(x) for x in zip(*combinations(range(PARTS), PARTS - 1), strict=True))


def bands(percent: int, size: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(own level, [(level, e, partitions)] for the own level and the next) of a set size.

    Band l ends at the largest size that can link with the band's first size; sizes that link lie in one band or two
    neighbours."""
    first, level = 1, 0
    while True:
        last = first * 100 // percent
        if size <= last:
            break
        first, level = last + 1, level + 1
    out = []
    for lv in (level, level + 1):
        # |r ^ s| = union - intersection, at most (100 - p) / (100 + p) * (|r| + |s|), and sizes are at most `last`
        k = (100 - percent) * 2 * last // (100 + percent)
        spare = int(np.ceil(SPARE * k))
        out.append((lv, spare, k // 2 + 1 + spare if k else 0))
        first = last + 1
        last = first * 100 // percent
    return level, out


class Signer:
    def __init__(self, percent: int) -> None:
        self.percent, self.by_size = percent, {}

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """The signatures of a set of distinct shingle hashes."""
        levels = self.by_size.get(len(s))
        if levels is None:
            levels = self.by_size[len(s)] = bands(self.percent, len(s))[1]
        out = [np.zeros(0, dtype=U64)]
        for level, spare, n in levels:
            if not n:  # no difference is allowed: the whole set is the signature
                out.append(mix(mix(s).sum(keepdims=True) + U64(level)))
                continue
            part = (((mix(s ^ U64(level + 1)) >> U64(32)) * U64(n * PARTS)) >> U64(32)).astype(np.int64)
            count = np.bincount(part, minlength=n * PARTS).reshape(n, PARTS)
            held = np.zeros(n * PARTS, dtype=U64)
            np.add.at(held, part, mix(s + U64(0x51_7CC1)))
            held, count = held.reshape(n, PARTS), count[:, _LEFT] + count[:, _RIGHT]
            # the largest t for which at most `spare` partitions have a subset of t shingles or fewer; those are left out
            t = int(np.searchsorted(np.cumsum(np.bincount(count.min(axis=1))), spare, side="right")) - 1
            keep = np.nonzero(count.ravel() > t)[0]
            both = (held[:, _LEFT] * U64(0x9E3779B97F4A7C15) + held[:, _RIGHT]).ravel()[keep]
            out.append(mix(both ^ mix(keep.astype(U64) + (U64(level + 1) << U64(32)))))
        return np.concatenate(out)


def _class_of(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def _bitmap(s: np.ndarray) -> bytes:
    """The parity of the set's members at each of 64 * BITMAP * 2^j places, at least as many as members; one differing
    member changes one bit at most. Two halves laid over one another are the bitmap of half the places."""
    places = 64 * BITMAP
    while places < len(s):
        places *= 2
    at = (mix(s ^ U64(0xB17)) >> U64(32)) % U64(places)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=places) & 1).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """A lower bound of how many members two sets differ in."""
    x, y = sorted((np.frombuffer(v, dtype=U64) for v in (a, b)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def classes(docs: DataFrame, n: int) -> DataFrame:
    """row key, doc_id, n_shingles, bytes, class (the hash of the set) and bitmap of each row."""

    def run(frames):
        for frame in frames:
            sets = list(text_sets(frame["text"], n))
            yield pd.DataFrame({KEY: frame[KEY], "doc_id": frame["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets], "bytes": [len(t or "") for t in frame["text"]], "class": np.array([_class_of(s) for s in sets], dtype=np.int64), "bits": pd.Series([_bitmap(s) for s in sets], dtype=object)})

    return docs.select(KEY, "doc_id", "text").mapInPandas(run, f"{KEY} long, doc_id long, n_shingles long, bytes long, class long, bits binary")


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, class): the signatures of each row's set."""

    def run(frames):
        sign = Signer(percent)
        for frame in frames:
            sigs, ids, held = [], [], 0
            for s in text_sets(frame["text"], n):
                if len(s):
                    sigs.append(sign(s))
                    ids.append(np.full(len(sigs[-1]), _class_of(s), dtype=np.int64))
                    held += len(ids[-1])
                if held > 500_000:
                    yield pd.DataFrame({"sig": np.concatenate(sigs).astype(np.int64), "class": np.concatenate(ids)})
                    sigs, ids, held = [], [], 0
            if sigs:
                yield pd.DataFrame({"sig": np.concatenate(sigs).astype(np.int64), "class": np.concatenate(ids)})

    return docs.select("text").mapInPandas(run, "sig long, class long")


def near(live: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that join the classes of each signature whose sizes and bitmaps allow a link.

    live: sig, class, n_shingles, bits; one row for each class of a signature, a signature's rows in one partition."""

    def fits(n, held, bits, i, j):
        a, b = n[i], n[j]
        i, j = np.broadcast_arrays(i, j)
        most = (100 - percent) * (a + b) // (100 + percent)
        ok = np.minimum(a, b) * 100 >= np.maximum(a, b) * percent
        ok &= np.bitwise_count(bits[i] ^ bits[j]).sum(axis=-1, dtype=np.int64) <= most
        for k in np.nonzero(ok & (most > 16 * BITMAP))[0]:  # sets too large for the short bitmaps
            ok[k] = _apart(held[i[k]], held[j[k]]) <= most[k]
        return ok

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        sig, cls, n = (frame[c].to_numpy() for c in ("sig", "class", "n_shingles"))
        whole = frame["bits"].tolist()
        bits = np.array([np.bitwise_xor.reduce(np.frombuffer(x, dtype=U64).reshape(-1, BITMAP)) for x in whole])
        first = np.nonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))[0]
        size = np.diff(np.append(first, len(sig)))
        before = np.arange(len(sig)) - np.repeat(first, size)
        left, right = [], []
        i = np.nonzero(np.repeat(size <= SHORT, size) & (before > 0))[0]
        d = 1
        while len(i):
            ok = fits(n, whole, bits, i, i - d)
            left.append(i[ok])
            right.append(i[ok] - d)
            d += 1
            i = i[before[i] >= d]
        for at, k in zip(first[size > SHORT], size[size > SHORT], strict=True):
            part = np.arange(k)  # components so far: what is joined is not compared again
            for x in range(k - 1):
                if (part == part[0]).all():
                    break
                y = x + 1 + np.nonzero(part[x + 1 :] != part[x])[0]
                y = y[fits(n, whole, bits, at + x, at + y)] if len(y) else y
                _, once = np.unique(part[y], return_index=True)
                for z in y[once]:
                    left.append([at + x])
                    right.append([at + z])
                    part[part == part[z]] = part[x]
        a, b = cls[np.concatenate(left).astype(int)] if left else [], cls[np.concatenate(right).astype(int)] if right else []
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, dtype="int64").drop_duplicates()

    def run(frames):
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            cut = int((frame["sig"] != frame["sig"].iloc[-1]).sum())  # sorted: the last signature may go on
            held, frame = frame.iloc[cut:], frame.iloc[:cut]
            if len(frame):
                yield edges(frame)
        if held is not None and len(held):
            yield edges(held)

    return live.sortWithinPartitions("sig", "class").mapInPandas(run, "a long, b long").distinct()


def verify(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links that span what is linked within each task of rows (task, block, class, text).

    A task is one block of a blob, or two different ones; then only pairs across them count."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sign = Signer(percent)
        ids, blocks = frame["class"].to_numpy(), frame["block"].to_numpy()
        sets = list(text_sets(frame["text"], n))
        size, across = np.array([len(s) for s in sets]), len(set(blocks)) > 1
        sigs = [sign(s) for s in sets]
        group = np.unique(np.concatenate(sigs), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in sigs])
        members = np.split(owner[np.argsort(group, kind="stable")], np.cumsum(np.bincount(group))[:-1])
        of = np.split(group, np.cumsum([len(s) for s in sigs])[:-1])
        item = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        items = np.split(item, np.cumsum(size)[:-1])
        parent, links = np.arange(len(ids)), []
        done, here = np.zeros(len(ids), dtype=bool), np.zeros(item.max() + 1, dtype=bool)
        # the texts that share signatures with most others come first: they link most of them at once
        for i in np.argsort([-sum(len(members[g]) for g in of[i]) for i in range(len(ids))], kind="stable"):
            done[i] = True
            near = np.unique(np.concatenate([members[g] for g in of[i]]))
            fits = ~done[near] & (parent[near] != parent[i]) & (np.minimum(size[near], size[i]) * 100 >= np.maximum(size[near], size[i]) * percent)
            near = near[fits & (blocks[near] != blocks[i])] if across else near[fits]
            if not len(near):
                continue
            here[items[i]] = True
            inter = np.add.reduceat(here[np.concatenate([items[j] for j in near])], np.cumsum(size[near]) - size[near], dtype=np.int64)
            here[items[i]] = False
            for j in near[100 * inter >= percent * (size[near] + size[i] - inter)]:
                if parent[j] != parent[i]:
                    parent[parent == parent[j]] = parent[i]
                    links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("task").applyInPandas(run, "a long, b long")


def link(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """row key, doc_id, n_shingles, class, component (its smallest class) and rep (whether the row stands for its class).

    docs has doc_id, text and a row key. Equal sets are one class and never compared. A null, empty or blank text has an
    empty set, which links with nothing. Rows that repeat are of one class."""
    rows = stage(classes(docs, n), "sets")
    by_sig = Window.partitionBy("sig")
    sigs = signatures(docs, n, percent)
    shared = sigs.withColumn("lo", F.min("class").over(by_sig)).withColumn("hi", F.max("class").over(by_sig)).where("lo <> hi")
    shared = shared.select("sig", "class").distinct()  # still dealt by signature
    facts = stage(rows.groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits")), "facts")
    few = facts.agg(F.coalesce(F.sum(F.length("bits") + 40), F.lit(0))).first()[0] <= FACTS_BYTES
    # a broadcast join leaves the rows where they are; more facts than that are joined by a shuffle, and rows dealt anew
    live = shared.join(F.broadcast(facts), "class") if few else shared.join(facts, "class").repartition("sig")
    blobs = stage(components(near(live, percent)), "blobs").withColumnRenamed("node", "class").withColumnRenamed("root", "blob")
    first = F.min(F.struct(KEY, "bytes")).alias("first")
    picked = rows.join(blobs, "class", "left_semi").groupBy("class").agg(first).join(blobs, "class").select("class", "blob", f"first.{KEY}", "first.bytes")
    picked = stage(picked, "picked")
    large = stage(picked.groupBy("blob").agg((F.greatest(F.sum("bytes") / BLOCK_BYTES, F.count("*") / BLOCK_TEXTS) + 1).cast("int").alias("blocks")).where("blocks > 1"), "large")
    picked = picked.join(small(large), "blob", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    picked = picked.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = picked.withColumn("other", other).withColumn("task", F.xxhash64("blob", F.least("block", "other"), F.greatest("block", "other")))
    texts = docs.select(KEY, "text").join(small(stage(pairs.select(KEY, "class", "block", "task"), "tasks")), KEY)
    links = stage(verify(texts, n, percent), "links")
    found = components(links).withColumnRenamed("node", "class").withColumnRenamed("root", "component")
    out = rows.join(found, "class", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "class")))
    return stage(out.drop("bytes", "bits"), "linked")


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id; a document without words is a component of its own. Null ids never lead one.

    Only components of two rows or more have a row in the table of leads."""
    linked = link(keyed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    many = linked.where("component is not null").groupBy("component").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead")).where("n > 1").drop("n")
    lead = stage(many, "leads").withColumn("found", F.lit(True))
    out = linked.join(small(lead), "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("found"), F.col("lead")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that link, directly or not, to one with a smaller id; texts without words all stay.

    Of ties in doc_id one row stays; null ids count as the largest. An empty table stays empty. The texts are not
    shuffled while at most BROADCAST_ROWS rows go; beyond that the rows are joined by a shuffle."""
    names = docs.columns
    rows = keyed(docs.select(F.struct(*names).alias("__row"), "doc_id", "text"))
    linked = link(rows, n, percent).where("component is not null")
    many = linked.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)).alias("lead"))
    lead = stage(many.where("n > 1").select("component", F.col(f"lead.{KEY}").alias("lead")), "leads")
    gone = linked.join(small(lead), "component").where(F.col(KEY) != F.col("lead")).select(KEY)
    return rows.join(small(stage(gone, "gone")), KEY, "left_anti").select("__row.*")
