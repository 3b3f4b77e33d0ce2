"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's rows form blocks. With weight w, its block k (from 0) is released at slot floor(k / w) and due by
ceil((k + 1) / w); in each slot the released block that is due first is taken. The weights are whole numbers, so the
schedule repeats after as many slots as they sum to, and one period of it (a table of at most MAX_PERIOD slots) places
every block, wherever its rows are. When a source has no blocks left, a new phase begins for the others. Within a phase
no source is ever a block or more away from its share.

Sources without a target weight, however many, are mixed in one pool, which has a target weight of its own and is
scheduled as one source; its rows are in the order of a hash, so each source of the pool keeps its share of it. Rows
without a source are one source more.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

BLOCK_ROWS, BUCKETS = 16, 512
#: The finest weight that can be given, as a share: weights, divided by their common divisor, sum to at most this.
MAX_PERIOD = 4096
#: Target weights of the sources; all others are mixed in a pool of weight POOL_WEIGHT, and so weighs the null source.
WEIGHTS = {f"src{i}": 1 + i % 4 for i in range(20)}
POOL_WEIGHT = 1
_NONE, _POOL = "\x00none", "\x00pool"
RESULTS = {"source_rank": "long", "block": "long", "slot": "long", "release": "long", "deadline": "long", "phase": "int", "position": "long"}


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period, taken by earliest deadline among the released."""
    return {s: list(x) for s, x in _period(tuple(sorted(weights.items()))).items()}


@lru_cache(maxsize=1024)
def _period(weights: tuple[tuple[str, int], ...]) -> dict[str, tuple[int, ...]]:
    common = math.gcd(*(w for _, w in weights))
    held = {s: w // common for s, w in weights}
    total = sum(held.values())
    if total > MAX_PERIOD:
        raise ValueError(f"the weights sum to {total}; at most {MAX_PERIOD} is allowed")
    slots: dict[str, list[int]] = {s: [] for s in held}
    waiting, ready = [(0, s) for s in held], []
    heapq.heapify(waiting)
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // held[s]), -held[s], s))
        s = heapq.heappop(ready)[2]
        slots[s].append(t)
        if len(slots[s]) < held[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // held[s], s))
    return {s: tuple(x + total * i for i in range(common) for x in slots[s]) for s in held}


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[int, dict[str, int], dict[str, int]]]:
    """(first slot, first block by source, weight by source) of each phase."""
    at, used, out = 0, dict.fromkeys(blocks, 0), []
    while left := {s: weights[s] for s in sorted(blocks) if used[s] < blocks[s]}:
        slots, total = period(left), sum(left.values())
        place = lambda s, k: k // left[s] * total + slots[s][k % left[s]]  # noqa: B023, E731
        out.append((at, {s: used[s] for s in left}, left))
        end = min(place(s, blocks[s] - used[s] - 1) for s in left) + 1
        for s in left:
            full, rest = divmod(end, total)
            used[s] += full * left[s] + sum(x < rest for x in slots[s])
        at += end
    return out


def _values(spark: SparkSession, rows: list[tuple], shape: str) -> DataFrame:
    """A constant table of numbers and hex-coded names, as a literal of the query."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({shape})")


def order(docs: DataFrame, weights: dict[str, int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with RESULTS; columns of docs of those names give way."""
    placed = _placed(docs, weights, block_rows)
    return placed.select(*[f"__row.{c}" for c in docs.columns if c not in RESULTS], *RESULTS)


def _placed(docs: DataFrame, weights: dict[str, int], block_rows: int) -> DataFrame:
    """(__row: docs' columns) with source_rank, block, slot, release, deadline (within the phase), phase and position (from 0, gapless).

    source_rank and block count within a weighted source, the null one or the pool; null ids come first within a part of
    a source, and rows that repeat take places next to one another. A source is ranked in BUCKETS
    parts, so one that holds most rows is spread over as many tasks. An empty table gives no rows. Weights that are not
    whole numbers of 1 or more, or finer than MAX_PERIOD, are an error."""
    spark = docs.sparkSession
    docs = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", *[c for c in ("text",) if c in docs.columns])
    if any(w < 1 or w != int(w) for w in weights.values()):
        raise ValueError("weights are whole numbers of 1 or more")
    known = F.col("source").isin(list(weights)) if weights else F.lit(False)
    source = F.when(F.col("source").isNull(), F.lit(_NONE)).when(known, F.col("source")).otherwise(F.lit(_POOL))
    rows = docs.withColumns({"__s": F.hex(F.encode(source, "utf-8")), "__b": F.pmod(F.xxhash64("doc_id", "source", F.crc32(F.coalesce("text", F.lit("")).cast("binary")) if "text" in docs.columns else F.lit(0)), F.lit(BUCKETS)).cast("int")})
    counts = stage(rows.groupBy("__s", "__b").agg(F.count("*").alias("n")).coalesce(1), "counts")
    totals = {r["__s"]: r["n"] for r in counts.groupBy("__s").agg(F.sum("n").alias("n")).collect()}  # one row a weight
    own = {s: int(weights.get(bytes.fromhex(s).decode(), POOL_WEIGHT)) for s in totals}
    plan = phases({s: -(-n // block_rows) for s, n in totals.items()}, own)
    if not plan:
        return docs.withColumns({c: F.lit(None).cast(t) for c, t in RESULTS.items()}).limit(0)
    # at most one row for each source, phase and block of a period
    slots = [(f"'{s}'", i, k, p, at, first[s], w, sum(ws.values())) for i, (at, first, ws) in enumerate(plan) for s, w in ws.items() for k, p in enumerate(period(ws)[s])]
    slots = _values(spark, [f"({', '.join(map(str, x))})" for x in slots], "__s, phase, k, place, at, first, weight, total")
    last = [(s, (n - 1) // block_rows) for s, n in totals.items() if n % block_rows]
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("__s", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    key = ["doc_id"] + [c for c in ("text",) if c in docs.columns]
    rank = F.row_number().over(Window.partitionBy("__s", "__b").orderBy(*key)) - 1
    rows = rows.withColumn("__rank", rank).join(F.broadcast(offset), ["__s", "__b"])
    rows = rows.withColumn("source_rank", F.col("__from") + F.col("__rank")).withColumn("block", F.expr(f"source_rank div {block_rows}"))
    # the phase of a block: the last one that begins at or before it
    starts = _phases_of(plan)
    phase = F.lit(None).cast("int")
    for s, begins in starts.items():
        these = F.lit(begins[0][1])
        for b, i in begins[1:]:
            these = F.when(F.col("block") >= b, i).otherwise(these)
        phase = F.when(F.col("__s") == s, these).otherwise(phase)
    firsts = {(s, i): (b, plan[i][2][s]) for s, begins in starts.items() for b, i in begins}
    shape = _values(spark, [f"('{s}', {i}, {b}, {w})" for (s, i), (b, w) in firsts.items()], "__s, phase, __first, __w")
    rows = rows.withColumn("phase", phase).join(F.broadcast(shape), ["__s", "phase"])
    rows = rows.withColumn("k", ((F.col("block") - F.col("__first")) % F.col("__w")).cast("int")).drop("__first", "__w")
    rows = rows.join(F.broadcast(slots), ["__s", "phase", "k"])
    nth = F.col("block") - F.col("first")
    rows = rows.withColumns({"slot": F.col("at") + F.expr("(block - first) div weight") * F.col("total") + F.col("place"), "release": F.col("at") + F.floor(nth * F.col("total") / F.col("weight")), "deadline": F.col("at") + F.ceil((nth + 1) * F.col("total") / F.col("weight"))})
    gap = F.lit(0).cast("long")
    for s, b in last:  # the rows that the last block of a source is short of
        i = max(i for x, i in starts[s] if x <= b)
        at, first, ws = plan[i]
        slot = at + (b - first[s]) // ws[s] * sum(ws.values()) + period(ws)[s][(b - first[s]) % ws[s]]
        gap = gap + F.when(F.col("slot") > slot, block_rows - totals[s] % block_rows).otherwise(0)
    rows = rows.withColumn("position", F.col("slot") * block_rows + F.col("source_rank") % block_rows - gap)
    return rows.select("__row", *[F.col(c).cast(t).alias(c) for c, t in RESULTS.items()])


def _phases_of(plan: list) -> dict[str, list[tuple[int, int]]]:
    """(first block, phase) of each source's phases in which it has blocks, in order."""
    out: dict[str, list[tuple[int, int]]] = {}
    for i, (_, first, _) in enumerate(plan):
        for s, b in first.items():
            if s in out and out[s][-1][0] == b:
                out[s].pop()
            out.setdefault(s, []).append((b, i))
    return out


def deviation(slot: int, taken: int, weight: int, total: int) -> Fraction:
    """How many blocks a source with `taken` blocks in the first `slot` slots is ahead of its share."""
    return taken - Fraction(slot * weight, total)


def mix(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """docs in mixed order: sorted by position over range partitions, with docs' columns."""
    placed = _placed(docs, WEIGHTS if weights is None else weights, BLOCK_ROWS)
    return placed.select("__row", "position").repartitionByRange("position").sortWithinPartitions("position").select("__row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """A place for each row of documents; null ids and sources have theirs, and an empty table gives no rows."""
    placed = order(table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)
    return placed.select("doc_id", "source", "block", "slot", "release", "deadline", "phase", "position")
