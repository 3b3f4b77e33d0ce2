"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items fall into classes by their number of shingles, (2^(c-1), 2^c]. For a class, documents are read as windows of two
neighbouring blocks of 2^c shingles, so every run of shingles as long as an item lies in a window, and containment in a
window becomes a Jaccard similarity of some size: at least 0.8 / 4.2 for the shortest item of a class. An item is a
candidate when one of its MinHash values is a window's; with BANDS values of one row each, an item of which 0.8 lies
in one window is missed with a probability below 2e-6, and one whose pieces lie in many windows has a chance in each.
Block minima are shared: the blocks of one class are pairs of blocks of the class below.

Benchmarks are read in blocks of ITEMS items; one block is what a task holds, and documents are scanned once a block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .shingles import U64, mix, shingle_hashes, text_hashes, words_of

WORDS, PERCENT, BANDS, ITEMS = 5, 80, 64, 50_000
#: Bytes of items in a block, and shingles of a document that are looked at together.
ITEM_BYTES, PIECE = 32_000_000, 16_384
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


class Index:
    """MinHash values of a block of items, by class, and the items' own shingles."""

    def __init__(self, items: list[tuple], n: int) -> None:
        self.n, self.ids, self.sets = n, [], []
        found: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            h = np.unique(shingle_hashes(next(text_hashes([text])), n))
            c = int(len(h) - 1).bit_length()
            at = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(frozenset(_shingles(words, n)))
            for band, value in enumerate((h[None, :] * _SEEDS[:, None]).min(axis=1)):
                found[c][band, int(value)].append(at)
        self.values = {c: (np.unique(np.array([v for _, v in of], dtype=U64)), dict(of)) for c, of in sorted(found.items())}

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items that share a MinHash value with a window of a document with these shingle hashes, in order.

        Long documents are read in pieces of whole blocks, each with the block behind it, so memory is bounded."""
        block = 1 << max(self.values, default=0)
        step = max(block, PIECE // block * block)
        out: set[int] = set()
        for lo in range(0, len(h), step):
            out |= self._candidates(h[lo : lo + step + block])
        return out

    def _candidates(self, h: np.ndarray) -> set[int]:
        out: set[int] = set()
        top = max(self.values, default=-1)
        least, size = None, 0
        low = min(self.values, default=0)
        for c in range(low, top + 1):
            if least is None:
                size = 1 << c
                starts = np.arange(0, len(h), size)
                least = np.empty((BANDS, len(starts)), dtype=U64)
                for b in range(BANDS):
                    least[b] = np.minimum.reduceat(h * _SEEDS[b], starts)
            else:
                size *= 2
                even = least if least.shape[1] % 2 == 0 else np.concatenate([least, least[:, -1:]], axis=1)
                least = np.minimum(even[:, 0::2], even[:, 1::2])
            if c not in self.values:
                continue
            window = np.minimum(least[:, :-1], least[:, 1:]) if least.shape[1] > 1 else least
            known, of = self.values[c]
            at = np.minimum(np.searchsorted(known, window.ravel()), len(known) - 1)
            for k in np.nonzero(known[at] == window.ravel())[0]:
                out.update(of.get((int(k // window.shape[1]), int(window.ravel()[k])), ()))
        return out

    def hits(self, texts: list[str | None], percent: int) -> Iterator[list[tuple[int, int]]]:
        """For each text, (item, shared shingles) of the items of which percent or more lie in it."""
        for text, h in zip(texts, text_hashes(texts), strict=True):
            near = self.candidates(shingle_hashes(h, self.n)) if len(h) and self.ids else ()
            own = _shingles(words_of(text), self.n) if near else set()
            shared = ((i, len(self.sets[i] & own)) for i in sorted(near))
            yield [(i, x) for i, x in shared if 100 * x >= percent * len(self.sets[i])]


def blocks(benchmark: DataFrame, size: int = ITEMS) -> Iterator[list[tuple]]:
    """The items (item_id, text), at most about `size` of them and ITEM_BYTES at a time."""
    items = benchmark.select("item_id", "text").where("text is not null")
    n, held = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // size), -(-held // ITEM_BYTES)) if n else 0
    for p in range(parts):
        rows = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        yield [tuple(r) for r in rows.orderBy("item_id", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared) for each document and item of which percent or more lie in it.

    Shingles are of n words; a text of fewer words is one shingle. Null and blank texts, of either kind, hit nothing;
    repeated documents and items each have rows of their own; ids may be null. Without documents or items there are no
    rows."""
    spark, out = docs.sparkSession, None
    shape = "doc_id long, item_id long, item_shingles long, shared long"
    for items in blocks(benchmark):
        held = spark.sparkContext.broadcast(items)

        def run(frames, held=held):
            index = Index(held.value, n)
            for frame in frames:
                rows = [(d, index.ids[i], len(index.sets[i]), x) for d, found in zip(frame["doc_id"], index.hits(frame["text"].tolist(), percent), strict=True) for i, x in found]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_shingles", "shared"]).astype("Int64")

        found = docs.select("doc_id", "text").mapInPandas(run, shape)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], shape) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs in which no benchmark item lies, with docs' columns; the texts are not shuffled."""
    names = docs.columns
    for items in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(frames, held=held):
            import pyarrow as pa
            index = Index(held.value, n)
            for batch in frames:
                clean = [not found for found in index.hits(batch.column("text").to_pylist(), percent)]
                yield batch.filter(pa.array(clean, type=pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*names)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
