"""Mixing sources to target weights on a low-discrepancy schedule.

Targets: each source gets its weight's share of all words, but at most ``MAX_REPEAT`` times its own; what is cut off is
shared out again by weight. A source's documents, shuffled by hash, are laid end to end and cut into blocks that differ
by one word at most and are small beside both the source and its target; it gets as many slots as its target holds such
blocks. Schedule: slot i has the point i * g mod 2**32, g the golden ratio's fraction of 2**32; in the order of their
points the slots go to the sources, and the slots of a source are ranked. Its slot of rank r takes block r modulo its
number of blocks. A document's share follows from joining its pieces with the slots of their blocks.

Ranks and running sums are taken in two levels, within about sqrt(n) hash buckets and over the buckets, so no source is
one task's work.

Defined cases: null text has no words; a null source is a source of its own, last in order; sources without words get
nothing; rows that repeat id and text lie side by side; rows without an id are mixed like
others; no words at all give targets of 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from hazlake.llm.common import doc_id_of, small, stored, with_key, words_of

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: At least so many blocks in each source and in its target, unless there are fewer words; blocks hold no more than MAX_BLOCK words.
BLOCKS, MAX_BLOCK = 500, 4096
GOLDEN, CIRCLE = 2654435769, 1 << 32
BROADCAST_ROWS = 1_000_000


def ranked(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Adds ``rank`` from 0 in the order of a column, over ranges of it that no single task holds together."""
    ranges = stored(df.repartitionByRange(max(1, math.isqrt(rows) // 256 + 1), F.col(order).asc_nulls_last()).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col(order).asc_nulls_last())) - 1
    return ranges.withColumn("rank", own).join(before, "range").withColumn("rank", F.col("rank") + F.col("before")).drop("range", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT) -> tuple[DataFrame, int, int]:
    """source, source_size, weight, target for each source; the number of sources and of all words."""
    sources = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n, total = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    order = ranked(sources, "source", n)
    weighted = stored(order.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint")), "weights")
    # the level rises until no source is above its limit; sources once at the limit stay there
    rate, limit = (0, 1), F.col("source_size") * most
    while True:
        at_limit = F.col("weight") * rate[0] >= limit * rate[1]
        full, open_weight = weighted.agg(F.coalesce(F.sum(F.when(at_limit, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0))).first()
        new = (total - full, open_weight) if open_weight else rate
        if new[0] * rate[1] <= rate[0] * new[1]:
            break
        rate = new
    share = F.col("weight") * F.lit(rate[0]) / F.lit(rate[1])
    return weighted.withColumn("target", F.least(limit.cast("double"), share.cast("double"))).select("source", "source_size", "weight", "target"), n, total


def placed(docs: DataFrame, n_docs: int) -> DataFrame:
    """did, th, source, size, start: where each text begins among its source's shuffled words."""
    buckets = max(1, math.isqrt(n_docs))
    shuffle = F.xxhash64(F.lit("mix"), "did", "th")
    spot = docs.withColumns({"place": shuffle, "bucket": F.pmod(shuffle, F.lit(buckets))})
    sums = spot.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("source", "bucket").orderBy("place", "did", "th", "copy")
    own = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    inner = spot.withColumn("copy", F.monotonically_increasing_id()).withColumn("own", own)
    both = inner.alias("a").join(before.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket")))
    return both.select("did", "th", "a.source", "size", (F.col("own") + F.col("before")).alias("start"), "place")


def point_of(slot: Column) -> Column:
    """slot * GOLDEN mod 2**32, in two halves that stay below 2**49."""
    low = slot % CIRCLE
    return (F.shiftright(low, 16) * GOLDEN % 65536 * 65536 + (low % 65536) * GOLDEN) % CIRCLE


def _div(a: Column, b: Column, c: Column, more: Column | int = 0) -> Column:
    """(a * b + more) div c of whole numbers, in 38 digits: a below 10**20, b below 10**17."""
    product = a.cast("decimal(20,0)") * b.cast("decimal(17,0)")
    return F.call_function("div", product + F.lit(more).cast("decimal(1,0)"), c.cast("decimal(20,0)"))


def block_of(word: Column, size: Column, blocks: Column) -> Column:
    """The block that holds a source's word: the last k with begin(k) <= word, of blocks that differ by one word at most."""
    return _div(word + 1, blocks, size, -1)


def begin(block: Column, size: Column, blocks: Column) -> Column:
    """The first word of a block: block * size / blocks, rounded down."""
    return _div(block, size, blocks)


def cut_up(plan: DataFrame, most: int) -> DataFrame:
    """Adds blocks and slots: how many blocks a source's words make, and how many of them its target holds."""
    block = F.least(F.col("source_size").cast("double"), "target") / BLOCKS
    block = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(block)))
    cut = plan.withColumn("blocks", F.ceil(F.col("source_size") / block))
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"), most * F.col("blocks"))
    return cut.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0))


def schedule(plan: DataFrame, n_sources: int) -> DataFrame:
    """slot, source, rank: which source each slot of the mix takes, and its rank among the source's slots."""
    n = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bins = max(1, 4 * n_sources)
    wide = ranked(plan.withColumn("width", F.col("slots")), "source", n_sources)
    parts = max(1, math.isqrt(n_sources) // 256 + 1)
    group = wide.withColumn("part", F.floor(F.col("rank") * parts / F.lit(max(1, n_sources))))
    sums = group.groupBy("part").agg(F.sum("width").alias("w"))
    before = sums.select("part", (F.sum("w").over(Window.orderBy("part")) - F.col("w")).alias("before"))
    own = F.sum("width").over(Window.partitionBy("part").orderBy("rank"))
    ends = group.withColumn("own", own).join(before, "part").select("source", "width", (F.col("own") + F.col("before")).alias("to")).where("width > 0")
    size = max(1, -(-n // bins))
    spread = ends.select("source", (F.col("to") - F.col("width")).alias("from"), "to").withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("from") / size), F.floor((F.col("to") - 1) / size))))
    spread = stored(spread, "schedule-bins")
    slots = plan.sparkSession.range(n).select(F.col("id").alias("slot"), point_of(F.col("id")).alias("u"))
    # points that wrap round the circle are told apart by their slot
    slots = ranked(slots.withColumn("point", F.struct("u", "slot")), "point", n).select("slot", F.col("rank").alias("place"))
    hit = slots.withColumn("bin", F.floor(F.col("place") / size)).join(small(spread, n_sources + bins, BROADCAST_ROWS), "bin").where("place >= from AND place < to")
    run = max(1, math.isqrt(n))
    taken = stored(hit.select("slot", "source", F.floor(F.col("slot") / run).alias("run")), "slots")
    sums = taken.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = sums.select("source", "run", (F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    both = taken.withColumn("own", own).alias("a").join(before.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.run") == F.col("b.run")))
    return both.select("slot", "a.source", (F.col("own") + F.col("before")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame]:
    """The mix's slots (slot, source, rank, number of the block), and per row of documents the words it gives.

    doc_id, source, size, source_size, target, taken.
    """
    sized = stored(with_key(docs, docs["source"].cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("bigint").alias("size")).drop("text"), "sizes")
    plan, n_sources, _ = targets(sized, weights, most)
    plan = stored(cut_up(plan, most), "targets")
    n_docs = sized.count()
    few = n_sources <= BROADCAST_ROWS // 10
    cuts = plan.select("source", "source_size", "blocks", "slots")
    cuts = F.broadcast(cuts) if few else cuts
    slots = schedule(plan, n_sources).alias("a").join(cuts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    slots = slots.select("slot", "a.source", "rank", (F.col("rank") % F.col("blocks")).alias("block"))
    uses = slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    rows = placed(sized, n_docs).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "placed")
    # blocks without a slot need no pieces
    at = lambda word: block_of(word, F.col("source_size"), F.col("blocks"))
    start_of = lambda k: begin(k, F.col("blk_size"), F.col("blk_count"))
    spot = rows.where("size > 0").alias("a").join(cuts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    spot = spot.select("row", "a.source", "start", (F.col("start") + F.col("size")).alias("end"), "source_size", "blocks", "slots")
    spot = spot.withColumns({"from": at(F.col("start")), "to": F.least(at(F.col("end") - 1), F.least("blocks", "slots") - 1)}).where(F.col("from") <= F.col("to"))
    pieces = spot.select("row", "source", "start", "end", F.col("source_size").alias("blk_size"), F.col("blocks").alias("blk_count"), F.explode(F.sequence("from", "to")).alias("block"))
    overlap = F.least(F.col("end"), start_of(F.col("b.block") + 1)) - F.greatest(F.col("start"), start_of(F.col("b.block")))
    taken = (
        pieces.alias("a").join(uses.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block")))
        .groupBy("row").agg(F.sum(overlap * F.col("times")).alias("taken"))
    )
    out = rows.join(taken, "row", "left").alias("a").join((F.broadcast(plan) if few else plan).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    return slots, out.select(doc_id_of(F.col("did")).alias("doc_id"), "a.source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    return mix(docs)[1].select("doc_id", "size", "source_size", "target", "taken")
