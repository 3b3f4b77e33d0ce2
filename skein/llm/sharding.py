"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

A row's key is its doc_id. Each shard has `vnodes` points on a ring; a key belongs to the next point clockwise. Each
shard may hold its share of the rows exactly (law `rows`: counts differ by one at most) and keeps its own keys until it
is full; what it has left is room, split over its points. Keys that find their shard full go on clockwise to the next
point with room. Where they end follows from prefix sums over the points alone: the overflowing key at place p of ring
order goes to place p + max(room before - overflow before) of the room, over the points up to its own, starting behind
the point that nothing overflows. So the plan is a table of a few thousand points, whatever the input, and rows are
dealt by one join with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, clashing, in_place, small, stage, table

SHARDS, VNODES = 24, 64
CELL_BITS = 14
#: Parts of an arc, by hash, in which its rows are ranked; so rows of one repeated doc_id do not meet in one task.
PARTS = 64


def _hash(*cols) -> F.Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 62) - 1))


def ring(spark, shards: int, vnodes: int) -> DataFrame:
    """(arc, shard, point): the virtual nodes in ring order."""
    points = spark.range(shards * vnodes).select((F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).cast("int").alias("v"))
    points = points.withColumn("point", _hash(F.lit("node"), "shard", "v"))
    return points.withColumn("arc", (F.row_number().over(Window.orderBy("point", "shard", "v")) - 1).cast("int"))


def arcs_of(keys: DataFrame, nodes: DataFrame, shards: int, vnodes: int) -> DataFrame:
    """keys (with `pos`) with `arc`, the first point at or after pos, round the ring.

    The ring is cut into CELLS cells; a cell's row has the number of points before it and the points within it."""
    cell = lambda c: F.shiftright(c, 62 - CELL_BITS)
    held = nodes.groupBy(cell("point").alias("cell")).agg(F.collect_list("point").alias("points"), F.count("*").alias("n"))
    cells = keys.sparkSession.range(1 << CELL_BITS).withColumnRenamed("id", "cell").join(F.broadcast(held), "cell", "left")
    cells = cells.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.select("cell", "base", F.coalesce("points", F.array().cast("array<bigint>")).alias("points"))
    out = keys.withColumn("cell", cell("pos")).join(F.broadcast(cells), "cell")
    below = F.size(F.filter("points", lambda p: p < F.col("pos")))
    return out.withColumn("arc", ((F.col("base") + below) % (shards * vnodes)).cast("int")).drop("cell", "base", "points")


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, place: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and home_shard for each row, and the columns of `place`.

    A null text has size 8 and the CRC of nothing. A null doc_id is keyed by the text's CRC and size, so many such
    rows do not meet at one place. Rows that repeat take neighbouring slots. An empty table gives no rows. Other
    columns are not read. A shard's room is dealt over its points beforehand, so a key that its shard has no place for
    may pass points of shards whose room lies elsewhere on the ring."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *place)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("pos", _hash(F.lit("key"), key)).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int"))
    nodes = stage(ring(spark, shards, vnodes).coalesce(1), "ring")
    rows = arcs_of(rows, nodes, shards, vnodes)
    # at most PARTS rows a point
    parts = stage(rows.groupBy("arc", "part").agg(F.count("*").alias("c")).coalesce(1), "parts")
    segments = stage(plan(parts.groupBy("arc").agg(F.sum("c").alias("c")), nodes, shards, vnodes).coalesce(1), "segments")
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("arc", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("from"))
    # ties in pos are ties in doc_id; equal rows may swap their slots, which changes nothing
    rank = F.row_number().over(Window.partitionBy("arc", "part").orderBy("pos", "doc_id", "text_crc32", "size", *place)) - 1
    placed = rows.withColumn("in_part", rank.cast("long")).join(F.broadcast(offsets), ["arc", "part"]).withColumn("rank", F.col("from") + F.col("in_part"))
    out = placed.join(F.broadcast(segments), (placed.arc == segments.seg_arc) & (placed["rank"] >= segments.lo) & (placed["rank"] < segments.hi))
    slot = F.col("slot0") + F.col("rank") - F.col("lo")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard", *place)


def plan(counts: DataFrame, nodes: DataFrame, shards: int, vnodes: int) -> DataFrame:
    """(seg_arc, lo, hi, shard, slot0): rows lo..hi-1 of an arc go to the slots of a shard from slot0 on.

    At most three rows a virtual node, whatever the input."""
    total = F.sum("c").over(Window.partitionBy())
    a = nodes.join(counts, "arc", "left").withColumn("c", F.coalesce("c", F.lit(0)).cast("long")).withColumn("n", total)
    a = a.withColumn("cap", (F.col("n") / shards).cast("long") + (F.col("shard") < F.col("n") % shards).cast("long"))
    # a shard keeps its own keys, point after point, until it is full; what it has left is room at its points
    own = Window.partitionBy("shard").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("kept_before", F.coalesce(F.sum("c").over(own), F.lit(0)))
    a = a.withColumn("keep", F.greatest(F.lit(0), F.least(F.col("c"), F.col("cap") - F.col("kept_before"))))
    a = a.withColumn("e", F.col("c") - F.col("keep")).withColumn("load", F.sum("keep").over(Window.partitionBy("shard")))
    a = a.withColumn("k", F.expr(f"(v + 1) * (cap - load) div {vnodes} - v * (cap - load) div {vnodes}"))
    a = a.withColumn("slot_from", F.expr(f"load + v * (cap - load) div {vnodes}"))
    stay = a.where("keep > 0").select(F.col("arc").alias("seg_arc"), F.col("shard").alias("home_shard"), F.lit(0).cast("long").alias("lo"), F.col("keep").alias("hi"), "shard", F.col("kept_before").alias("slot0"))
    order = Window.orderBy("arc")
    a = a.withColumn("s", F.sum(F.col("e") - F.col("k")).over(order))
    # start behind the point where the sum of overflow less room is smallest: nothing overflows it
    start = F.min(F.struct("s", "arc")).over(Window.partitionBy())
    a = a.withColumn("turn", ((F.col("arc") - start["arc"] - 1 + shards * vnodes) % (shards * vnodes)))
    order = Window.orderBy("turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("over_before", F.coalesce(F.sum("e").over(before), F.lit(0))).withColumn("room_before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    a = a.withColumn("p", F.col("over_before") + F.max(F.col("room_before") - F.col("over_before")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = a.where("e > 0").select(F.col("p").alias("x"), F.struct("arc", F.col("shard").alias("home"), "e", "p", "keep").alias("over"), F.lit(None).cast("struct<shard:int,k:bigint,slot_from:bigint,q:bigint>").alias("space"))
    space = a.where("k > 0").select(F.col("room_before").alias("x"), F.lit(None).cast(over.schema["over"].dataType).alias("over"), F.struct("shard", "k", "slot_from", F.col("room_before").alias("q")).alias("space"))
    # both cut the line of places; each piece between two cuts has the last overflow and the last space that began
    cuts = Window.orderBy("x", F.col("over").isNull())
    both = over.union(space).select("x", F.lead("x").over(cuts).alias("to"), F.last("over", True).over(cuts).alias("l"), F.last("space", True).over(cuts).alias("s"))
    end = F.least(F.coalesce("to", F.col("l.p") + F.col("l.e")), F.col("l.p") + F.col("l.e"))
    first = F.col("l.keep") - F.col("l.p")
    moved = both.withColumn("to", end).where("x < to").select(F.col("l.arc").alias("seg_arc"), F.col("l.home").alias("home_shard"), (F.col("x") + first).alias("lo"), (F.col("to") + first).alias("hi"), F.col("s.shard").alias("shard"), (F.col("s.slot_from") + F.col("x") - F.col("s.q")).alias("slot0"))
    return stay.union(moved)


def shard_in_order(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """docs' rows, texts included, with size, text_crc32, law, shard, slot, grown_shard and home_shard.

    Slots of a shard are numbered in the order of docs' rows, as staged: files by name, then rows. A row's slot is its
    rank among its file's rows of the shard, behind those of earlier files, so no task holds a whole shard; the texts
    are shuffled once, when they are joined with their places. Columns of docs that are named like the results give way.
    An empty table gives no rows."""
    names = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "home_shard")
    rows = in_place(clashing(docs, FILE, ROW, *names))
    placed = stage(shard(rows, shards, vnodes, (FILE, ROW)).drop("slot", "doc_id"), "places")
    held = placed.groupBy("shard", FILE).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(held.select("shard", FILE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")), "offsets")
    rank = F.row_number().over(Window.partitionBy("shard", FILE).orderBy(ROW)) - 1
    slots = placed.withColumn("in_file", rank.cast("long")).join(small(offsets), ["shard", FILE]).withColumn("slot", F.col("from") + F.col("in_file"))
    return rows.join(slots.select(FILE, ROW, *names), [FILE, ROW]).drop(FILE, ROW)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """shard() over all documents; nulls count as there."""
    return shard(table(spark, sf_dir, "documents"))
