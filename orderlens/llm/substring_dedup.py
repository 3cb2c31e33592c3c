"""Removal of long repeated word spans by compaction of a De Bruijn graph of the corpus.

Edges of the graph are the windows of `WINDOW` words, nodes the spans of WINDOW - 1 words between two of them. A path of
edges that does not branch is compacted:

1. inside a text, first: consecutive windows that share their least-hashed span of `ANCHOR` words at one place form a
   run, and runs stand for their edges from here on. Equal windows have equal least spans at equal places.
2. Least spans that name a single run in the corpus are dropped: their windows occur once.
3. Runs are counted by (least span, hash of all their words), with the runs before and after them in every text. A run
   found twice is repeated as a whole. Its out-degree is one if all its occurrences are followed by one and the same run,
   its in-degree is one if all are preceded by one and the same.
4. Where a run's only successor has it as its only predecessor, the two join. Chains of such links compact by pointer
   doubling joins into unbranched paths, which are named by their first run; each occurrence of that run begins an
   occurrence of the whole path.
5. Where a least span also names a run found once, runs may overlap in part. One representative of each of its distinct
   runs is opened into windows, these are counted over the corpus, and each run gets a bit mask of repeated windows.
6. Source coordinates (document, first word, windows, mask) of paths and of masked runs go back to the documents, which
   drop the covered words.

No repeat is lost; a window is matched by two independent 64-bit hashes, and words are not compared once more. No group
is gathered: counts and degrees are partial aggregates, and the joins that carry occurrences have both sides freshly
dealt, so adaptive execution splits hot keys.

Defined cases: a null text has no words; a text shorter than a window keeps all words; a repeated row repeats all its
windows; rows may share an id; a row without an id is kept; other columns never take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .scratch import Scratch
from .words import SpanHashes, Words, pieces, signed

WINDOW = 35
ANCHOR = 10


class Paths:
    """The minimizer runs of a run of texts, in order of their first window."""

    def __init__(self, words: Words, window: int = WINDOW, anchor: int = ANCHOR):
        self.words = words
        self.window = window
        hashes = words.hashes()
        self.anchors = SpanHashes(hashes, 0)
        self.contents = SpanHashes(hashes, 1)
        n = words.n - window + 1
        if n <= 0:
            self.start = self.length = self.anchor = self.doc = np.zeros(0, np.int64)
            return
        value = self.anchors.windows(anchor)
        place = np.arange(len(value))
        span, width = window - anchor + 1, 1
        while width < span:  # sliding minimum, leftmost first, by doubling
            step = min(width, span - width)
            less = value[step:] < value[:-step]
            value, place = np.where(less, value[step:], value[:-step]), np.where(less, place[step:], place[:-step])
            width += step
        owner = words.owner()
        inside = np.flatnonzero(owner[:n] == owner[window - 1 : window - 1 + n])
        value, place = value[inside], place[inside]
        if not len(inside):
            self.start = self.length = self.anchor = self.doc = np.zeros(0, np.int64)
            return
        opens = np.append(True, (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1))
        at = np.flatnonzero(opens)
        self.start = inside[at]
        self.length = np.diff(np.append(at, len(inside)))
        self.anchor = value[at]
        self.doc = owner[self.start]

    def keys(self) -> np.ndarray:
        return self.contents.spans(self.start, self.length + (self.window - 1))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        names, times = np.unique(Paths(Words(piece.column("text"))).anchor, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(names.astype(np.uint64))), pa.array(times)], names=["anchor", "n"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        paths = Paths(Words(piece.column("text")))
        take, name = pa.array(paths.doc), signed(paths.keys()) if len(paths.start) else np.zeros(0, np.int64)
        same = paths.doc[1:] == paths.doc[:-1]
        after, before = np.append(np.where(same, name[1:], 0), 0)[: len(name)], np.append(0, np.where(same, name[:-1], 0))[: len(name)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(paths.anchor.astype(np.uint64))), pa.array(name), piece.column("_id").take(take), piece.column("_text").take(take), pa.array((paths.start - paths.words.first[paths.doc]).astype(np.int32)), pa.array(paths.length.astype(np.int8)), pa.array(before), pa.array(after)],
            names=["anchor", "path", "_id", "_text", "start", "length", "before", "after"],
        )


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the paths listed with each text."""
    for piece in pieces(batches, "text"):
        words = Words(piece.column("text"))
        contents = SpanHashes(words.hashes(), 1)
        listed = piece.column("paths")
        doc = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
        flat = listed.flatten()
        start = flat.field("start").to_numpy().astype(np.int64) + words.first[doc]
        length = flat.field("length").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(start)), length)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        window = contents.spans(start[row] + offset, np.int64(WINDOW))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([flat.field("anchor").take(take), flat.field("path").take(take), pa.array(offset.astype(np.int8)), pa.array(signed(window)), flat.field("n").take(take)], names=["anchor", "path", "offset", "window", "n"])


def _covered(words: Words, marks: pa.ListArray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a repeated window."""
    doc = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
    flat = marks.flatten()
    if not len(flat):
        return np.zeros(words.n, bool)
    start = flat.field("start").to_numpy().astype(np.int64) + words.first[doc]
    mask, windows = flat.field("mask").to_numpy().astype(np.int64), flat.field("windows").to_numpy()
    edges = np.zeros(words.n + 1, np.int64)
    whole = windows > 0
    np.add.at(edges, start[whole], 1)
    np.add.at(edges, (start + windows + window - 1)[whole], -1)
    start, mask = start[~whole], mask[~whole]
    for bit in range(WINDOW - ANCHOR + 1):
        hit = start[(mask >> bit) & 1 == 1] + bit
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _cut(digest: bool):
    """Removes covered words; returns texts, or their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            marks = piece.column("marks")
            marks = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.nan_to_num(pc.list_value_length(marks).to_numpy(zero_copy_only=False)))).astype(np.int32), marks.flatten()) if marks.null_count else marks
            words = Words(piece.column("text"))
            gone = _covered(words, marks)
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(words.first[:-1], words.n)) if len(words.count) else np.zeros(0, np.int64)
            removed = np.where(words.count == 0, 0, removed)
            names = words.vocabulary.cast(pa.string())
            kept = ~gone
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(words.count - removed)).astype(np.int32), names.take(pa.array(words.ids[kept])))
            texts = pc.binary_join(lists, " ")
            if digest:
                out = pa.array([hashlib.sha256(t.as_buffer() if t.is_valid else b"").hexdigest() for t in texts], pa.string())
            else:
                whole = pa.array(removed == 0)
                out = pc.if_else(whole, piece.column("text"), texts)
            yield pa.RecordBatch.from_arrays([piece.column("_row"), pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64)), out], names=["_row", "n_words", "n_removed", "kept"])

    return run


def unbranched_paths(kinds: DataFrame, scratch: Scratch) -> DataFrame:
    """(anchor, path, windows) of the first run of each unbranched path of repeated runs, and the path's windows.

    A link joins run and successor where out-degree and in-degree are one. Every chain ends, as the last run of a text has
    no successor; each round doubles how far a run's pointer reaches back, and the windows that lie in between.
    """
    runs = kinds.where("n > 1").select("anchor", "path", "length", *(F.when(F.col(f"{x}_low") == F.col(f"{x}_high"), F.col(f"{x}_low")).alias(x) for x in ("before", "after")))
    runs = scratch.write(runs, "runs")
    first = runs.where("after <> 0").select(F.col("path").alias("back"), F.col("after").alias("path"), F.col("length").cast("bigint").alias("far"))
    pointers = scratch.write(runs.where("before <> 0").select("path", F.col("before").alias("back")).join(first, ["path", "back"]).distinct(), "pointers-0")
    step = 0
    while True:
        further = pointers.toDF("back", "_back", "_far")
        jumped = pointers.join(further, "back", "left").select("path", F.coalesce("_back", "back").alias("back"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.col("_back").isNotNull().alias("moved"))
        step += 1
        jumped = scratch.write(jumped, f"pointers-{step}")
        scratch.drop(f"pointers-{step - 1}")
        pointers = jumped.select("path", "back", "far")
        if jumped.where("moved").isEmpty():
            break
    reach = runs.join(pointers, "path", "left").select(F.coalesce("back", "path").alias("path"), (F.coalesce("far", F.lit(0)) + F.col("length")).alias("windows"))
    totals = reach.groupBy("path").agg(F.max("windows").cast("int").alias("windows"))
    return runs.join(pointers.select("path"), "path", "left_anti").select("anchor", "path").join(totals, "path")


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Coordinates of repeated windows: (_id, _text, marks), marks being an array of (start, windows, mask of window starts).

    A mark with windows > 0 covers that many windows from its start; one with 0 those of its mask.
    """
    text = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("_id"), F.xxhash64("text").alias("_text"), "text").where("text is not null")
    named = text.select("text").mapInArrow(_counts, "anchor bigint, n bigint")
    twice = scratch.write(named.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    found = text.mapInArrow(_occurrences, "anchor bigint, path bigint, _id bigint, _text bigint, start int, length tinyint, before bigint, after bigint")
    paths = scratch.write(found.join(twice, "anchor", "left_semi"), "paths")
    ends = [f(x).alias(f"{x}_{n}") for x in ("before", "after") for n, f in (("low", F.min), ("high", F.max))]
    kinds = scratch.write(paths.groupBy("anchor", "path").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("length"), F.min(F.struct("_id", "_text", "start", "length")).alias("at"), *ends), "kinds")
    branching = scratch.write(kinds.where("n = 1").select("anchor").distinct(), "branching")
    listed = kinds.join(branching, "anchor", "left_semi").select("at.*", "anchor", "path", "n")
    listed = listed.groupBy("_id", "_text").agg(F.collect_list(F.struct("start", "length", "anchor", "path", "n")).alias("paths"))
    opened = text.join(listed, ["_id", "_text"]).dropDuplicates(["_id", "_text"]).select("text", "paths").mapInArrow(_open, "anchor bigint, path bigint, offset tinyint, window bigint, n bigint")
    windows = scratch.write(opened, "windows")
    again = scratch.write(windows.groupBy("anchor", "window").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "window"), "again")
    partly = windows.where("n = 1").join(again, ["anchor", "window"], "left_semi").groupBy("anchor", "path").agg(F.bit_or(F.expr("shiftleft(1L, cast(offset as int))")).alias("mask"))
    whole = unbranched_paths(kinds, scratch).select("anchor", "path", "windows", F.lit(0).cast("bigint").alias("mask"))
    spans = scratch.write(whole.unionByName(partly.withColumn("windows", F.lit(0))), "spans")
    marks = paths.select("anchor", "path", "_id", "_text", "start").join(spans, ["anchor", "path"]).groupBy("_id", "_text").agg(F.collect_set(F.struct("start", "windows", "mask")).alias("marks"))
    marks = scratch.write(marks, "marks")
    scratch.drop("anchors", "paths", "kinds", "branching", "windows", "again", "runs", "spans")
    return marks


def _joined(docs: DataFrame) -> DataFrame:
    """(_row, text, marks): the columns but text, packed so that no name can clash, the text, and its coordinates."""
    marks = repeated_spans(docs, Scratch(docs.sparkSession, "substring_dedup"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*rest).alias("_row"), F.col("text").alias("text"))
    keyed = keyed.withColumns({"_id": F.coalesce(F.col("_row.doc_id").cast("bigint"), F.lit(2**63 - 1)), "_text": F.xxhash64("text")})
    return keyed.join(marks, ["_id", "_text"], "left").select("_row", "text", "marks")


def _schema(joined: DataFrame) -> StructType:
    return StructType([joined.schema["_row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])


def repeated_word_counts(docs: DataFrame) -> DataFrame:
    """For each document: words, words removed, and the digest of those kept."""
    joined = _joined(docs.select("doc_id", "text"))
    cut = joined.mapInArrow(_cut(True), _schema(joined))
    return cut.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """The documents without their repeated spans, with all their columns; an untouched text keeps its white space.

    A text that loses words keeps the rest joined by single spaces; a null text stays null.
    """
    joined = _joined(docs)
    cut = joined.mapInArrow(_cut(False), _schema(joined))
    return cut.select(*(F.col("kept").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
