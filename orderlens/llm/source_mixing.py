"""Mixing of sources to target weights by a low-discrepancy schedule.

Each source's documents are laid, in a shuffled order, on a line of words that is cut into equal blocks and repeated
without end. A source's last block is cut to the words that its rounded target still lacks. Slots of the mix take
golden-ratio points: slot i gets the source whose interval of cumulative blocks holds the fractional part of i times the
golden ratio, so every stretch of the mix has nearly the target shares. A slot's rank among its source's slots names the
block it takes; the few slots that a source gets too many go to the blocks that others got too few for.

No source is sorted or numbered in one task: lines are built from hashed buckets of bounded size, ranks from chunks.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a document of size 0 is
never taken; rows may repeat or share an id, and each is mixed for itself; an empty table, or one without words, takes
nothing; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .scratch import Scratch
from .words import Words, pieces

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
GOLDEN = 0.6180339887498949
CELLS = 4096
BUCKET_ROWS = 20_000
CHUNK = 8192


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        rest = [c for c in piece.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), pa.array(Words(piece.column("text")).count.astype(np.int64))], names=[*rest, "size"])


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds `target` to (source, source_size): the weights' share of 150% of all words, at most twice the source.

    What a source cannot take is shared again by weight. In order of limit over weight, the sources up to some point
    are full, and the others get one level times their weight; the level is found from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)).withColumn("most", F.col("source_size") * float(LIMIT))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = (
        ranked.withColumn("wanted", F.sum("source_size").over(everything) * SHARE)
        .withColumn("below", F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.coalesce("below", F.lit(0.0))) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return filled.select("source", "source_size", target.alias("target"))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(slot, source, chunk): slots dealt to sources by golden-ratio points through the cumulative `blocks`."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = Window.orderBy(F.col("source").asc_nulls_last())
    ends = targets.where("blocks > 0").withColumn("to", F.sum("blocks").over(line.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("blocks").over(everything))
    ends = ends.withColumn("from", F.coalesce(F.lag("to").over(line), F.lit(0.0))).withColumn("to", F.when(F.lead("to").over(line).isNull(), F.lit(1.0)).otherwise(F.col("to")))
    # Each interval lies in the cells of a grid over [0, 1); a slot meets the intervals of its own cell only.
    cells = ends.select("source", "from", "to", F.explode(F.sequence(F.floor(F.col("from") * CELLS).cast("int"), F.least(F.floor(F.col("to") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    points = targets.sparkSession.range(slots).withColumn("u", (F.col("id") + 0.5) * GOLDEN).select(F.col("id").alias("slot"), (F.col("u") - F.floor("u")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    dealt = points.join(cells, "cell").where("u >= `from` and u < `to`").select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    return dealt


def ranked_schedule(targets: DataFrame, slots: int) -> DataFrame:
    """`schedule` with each slot's rank within its source, from counts of chunks and ranks inside them."""
    dealt = schedule(targets, slots)
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = dealt.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").withColumnRenamed("source", "_source").withColumnRenamed("chunk", "_chunk")
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    joined = inside.join(chunks, (F.col("chunk") == F.col("_chunk")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("slot", "source", (F.col("before") + F.col("inside")).alias("rank"))


def settled_schedule(targets: DataFrame, slots: int, scratch: Scratch) -> DataFrame:
    """(slot, source, rank) with each of a source's `blocks` ranks once, for slots as many as blocks.

    Spare and missing slots differ from the golden-ratio deal by its discrepancy, a few for each source.
    """
    ranked = scratch.write(ranked_schedule(targets, slots), "slots")
    wanted = targets.select(F.col("source").alias("_source"), "blocks")
    held = ranked.join(wanted, F.col("source").eqNullSafe(F.col("_source")))
    spare = held.where("rank >= blocks").select("slot", F.row_number().over(Window.orderBy("slot")).alias("turn"))
    dealt = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    short = wanted.join(dealt, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks")
    short = short.select(F.col("_source").alias("source"), F.explode(F.sequence("n", F.col("blocks") - 1)).alias("rank"))
    short = short.withColumn("turn", F.row_number().over(Window.orderBy("rank", F.col("source").asc_nulls_last())))
    return held.where("rank < blocks").select("slot", "source", "rank").unionByName(spare.join(short, "turn").select("slot", "source", "rank"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, slots) for every document.

    `taken` counts words, repeats included; `slots` holds the first slot of each time that the document is taken.
    """
    scratch = Scratch(docs.sparkSession, "source_mixing")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("_text"), F.col("text").alias("text"))
    sized = rows.mapInArrow(_sizes, "doc_id bigint, source string, _text bigint, size bigint")
    return _mix(scratch.write(sized.withColumn("_row", F.monotonically_increasing_id()), "sizes"), scratch).drop("_row")


def _mix(sized: DataFrame, scratch: Scratch) -> DataFrame:
    """`mix_sources` of written rows (_row, doc_id, source, _text, size), by `_row`."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(totals.select("source", "source_size")).withColumn("goal", F.round("target").cast("bigint"))
    targets = scratch.write(targets, "targets")
    wanted, count = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0], sized.count()
    if not wanted:
        return sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast("array<bigint>").alias("slots"), "_row")
    block = int(max(16, min(1024, wanted // 16384)))
    targets = targets.withColumn("blocks", F.ceil(F.col("goal") / block))
    slots = targets.agg(F.sum("blocks")).first()[0]
    # The line: buckets of documents by hash, then running sums inside a bucket.
    order = F.xxhash64("doc_id", "_text", F.lit(5))
    lined = sized.withColumn("_order", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("_order", 20), F.lit(max(1, count // BUCKET_ROWS))))
    buckets = lined.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    buckets = buckets.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before")
    inside = Window.partitionBy("source", "bucket").orderBy("_order", "_row")
    placed = lined.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(buckets, (F.col("bucket") == F.col("_bucket")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_bucket")
    named = targets.select(F.col("source").alias("_source"), "source_size", "target", "goal")
    placed = scratch.write(placed.join(F.broadcast(named) if totals.count() <= 10_000 else named, F.col("source").eqNullSafe(F.col("_source"))).select("_row", "doc_id", "source", "size", "source_size", "target", "goal", (F.col("before") + F.col("inside")).alias("start")), "line")
    # Pieces: a document's words in each block of the first two rounds of its line, up to the source's goal.
    passes = placed.where("size > 0").select("_row", "source", "size", "goal", F.posexplode(F.array(*(F.col("start") + F.col("source_size") * k for k in range(LIMIT)))).alias("round", "a")).where("a < goal")
    passes = passes.withColumn("b", F.least(F.col("a") + F.col("size"), "goal"))
    parts = passes.select("_row", "source", "round", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("rank"))
    parts = parts.select("_row", F.col("source"), "round", "rank", (F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)).alias("words"))
    taken_blocks = settled_schedule(targets.select("source", "blocks"), slots, scratch).select("slot", F.col("source").alias("_source"), F.col("rank").alias("_rank"))
    met = parts.join(taken_blocks, (F.col("rank") == F.col("_rank")) & F.col("source").eqNullSafe(F.col("_source")))
    first = F.array(*(F.min(F.when(F.col("round") == k, F.col("slot"))) for k in range(LIMIT)))
    taken = met.groupBy("_row").agg(F.sum("words").alias("taken"), F.array_compact(first).alias("slots"))
    out = placed.join(taken, "_row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "slots", "_row")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts where all `size` words are wanted, else their first `wanted` words."""
    for piece in pieces(batches, "text"):
        texts = piece.column("text").to_pylist()
        wanted = piece.column("wanted").to_numpy()
        short = np.flatnonzero(wanted < piece.column("size").to_numpy())
        if len(short):
            words = Words(piece.column("text").take(pa.array(short)))
            for i, first in zip(short.tolist(), words.first.tolist(), strict=False):
                texts[i] = " ".join(words.vocabulary.take(pa.array(words.ids[first : first + wanted[i]])).to_pylist())
        yield pa.RecordBatch.from_arrays([piece.column("_row"), pa.array(texts, pa.string())], names=["_row", "text"])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, in the order of its slots: each document as often as it is taken, the last time cut to the words taken.

    All of a source's blocks up to its goal are taken, so the only document that a block holds in part stands where the
    goal ends its source's line, and the words of it that the block holds are its first ones. A document's place is the
    first slot that takes a word of it; documents of one slot are ordered as they were read. Rows are told apart by a
    number of their own, so equal ids and equal texts meet nowhere.
    """
    scratch = Scratch(docs.sparkSession, "source_mixing")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = docs.select(F.monotonically_increasing_id().alias("_id"), F.struct(*rest).alias("_row"), F.col("text").alias("text"))
    kept = scratch.write(packed, "documents")
    rows = kept.select(F.col("_id").alias("_row"), F.col("_row.doc_id").cast("bigint").alias("doc_id"), F.col("_row.source").cast("string").alias("source"), F.xxhash64("text").alias("_text"), "text")
    sized = rows.mapInArrow(_sizes, "_row bigint, doc_id bigint, source string, _text bigint, size bigint")
    taken = _mix(scratch.write(sized, "sizes"), scratch).where("taken > 0").select(F.col("_row").alias("_id"), "size", "taken", "slots")
    times = kept.join(taken, "_id").select("_id", "_row", "text", "size", "taken", F.posexplode("slots").alias("time", "slot"))
    ordered = times.orderBy("slot", "_id").select("_row", "text", "size", F.least("size", F.col("taken") - F.col("time") * F.col("size")).alias("wanted"))
    out = ordered.mapInArrow(_cut, StructType([packed.schema["_row"], packed.schema["text"]]))
    return out.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
