"""Audit of filters that overlap: what each one removes, repeats and loses in every order of application.

Filters are bits of a failure mask, named by letters: A under 100 words; B distinct words below 80% of the words; C more
than 10% of the code points are A-Z; D holds one of ``#$%&*|``; E the text equals that of a smaller doc_id anywhere.

E comes from a sort. Rows are range-partitioned by (text fingerprint, doc_id, row number), so that a crowd of copies is
dealt over many tasks, and sorted in each task by fingerprint, full text and doc_id. A row fails if the first row of its
stretch of equal texts has a smaller doc_id. A stretch may have begun in an earlier task: each task writes its stretches of
its first and last fingerprint with their texts and first ids, some two rows a task, and a join of these decides the rows
that stand first in a task's stretch. Texts are compared whole; the fingerprint only orders them.

Masks then count into additive cells (part, mask): a part has 2^5 cells at most, and all orders are read off these.

Defined cases: null texts count as empty, a null part (lang) as the empty string; a row without doc_id never fails E and
is nobody's smaller id; repeated rows of one id count each, and do not fail E by one another; a document is good or toxic
if any row of its id in the labels says so; an empty table has no parts; other columns never take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .words import Words, pieces, text_bytes

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = b"#$%&*|"
COPY = 1 << LETTERS.index("E")
_NOBODY = 2**63 - 1


def text_masks(column: pa.Array) -> np.ndarray:
    """Failure bits A to D of each text."""
    words, (data, begin) = Words(column), text_bytes(column)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask, dtype=np.int64))
        return sums[begin[1:]] - sums[begin[:-1]]

    seen = np.sort(words.owner() * max(1, len(words.vocabulary)) + words.ids)
    distinct = np.bincount(seen[np.append(True, seen[1:] != seen[:-1])] // max(1, len(words.vocabulary)) if words.n else seen, minlength=len(words.count))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    fails = [
        words.count < MIN_WORDS,
        100 * distinct < MIN_DISTINCT_PERCENT * words.count,
        100 * total((data >= 65) & (data <= 90)) > MAX_CAPITAL_PERCENT * total((data & 0xC0) != 0x80),
        total(symbol[data]) > 0,
    ]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


_JUDGED = "kind tinyint, _pid int, _group bigint, _id bigint, part string, mask int, open boolean, fp bigint, text string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one task. Kind 0: each row's mask, open where an earlier task may hold its text. Kind 1: stretches of
    the task's first and last fingerprint, with their first id."""
    names = [x.split()[0] for x in _JUDGED.split(", ")]
    pid = first_fp = last = None  # last: fingerprint, text, group and first id of the row before
    tail: list[tuple] = []  # stretches of the present fingerprint

    def ends(found: list[tuple]) -> pa.RecordBatch:
        group, start, fp, text = (list(x) for x in zip(*found, strict=True))
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int8()), pa.array([pid] * n, pa.int32()), pa.array(group, pa.int64()), pa.array(start, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array(fp, pa.int64()), pa.array(text, pa.string())], names=names)

    for piece in pieces(batches, "text"):
        text, fp, ids = piece.column("text"), piece.column("fp").to_numpy(), piece.column("_id").to_numpy()
        same = np.append(False, fp[1:] == fp[:-1])
        if same.any():
            same[1:] &= pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        if last is None:
            pid, first_fp = piece.column("_pid")[0].as_py(), int(fp[0])
        else:
            same[0] = last[0] == fp[0] and last[1] == text[0].as_py()
        begins = np.flatnonzero(~same)
        group = np.cumsum(~same) + (last[2] if last else -1)
        starts = np.append([last[3]] if same[0] else np.zeros(0, np.int64), ids[begins]).astype(np.int64)  # first id of each group here
        start = starts[group - group[0]]
        known = ids != _NOBODY
        mask = text_masks(text) | np.where(known & (ids > start), COPY, 0).astype(np.int32)
        open_ = known & (ids == start) & (fp == first_fp)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), piece.column("_pid"), pa.array(group), pa.array(ids), piece.column("part"), pa.array(mask), pa.array(open_), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=names)
        if tail and tail[0][2] != fp[-1]:
            if tail[0][2] == first_fp:
                yield ends(tail)
            tail = []
        if len(early := begins[(fp[begins] == first_fp) & (fp[begins] != fp[-1])]):
            yield ends([(int(group[i]), int(ids[i]), int(fp[i]), text[i].as_py()) for i in early])
        tail += [(int(group[i]), int(ids[i]), int(fp[i]), text[i].as_py()) for i in begins[fp[begins] == fp[-1]]]
        last = (int(fp[-1]), text[n - 1].as_py(), int(group[-1]), int(start[-1]))
    if tail:
        yield ends(tail)


def failure_masks(docs: DataFrame, scratch: Scratch, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id fail which filters."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NOBODY)).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"fp": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("fp", "_id", "_row").sortWithinPartitions("fp", "text", "_id")
    judged = scratch.write(dealt.select(F.spark_partition_id().alias("_pid"), "_id", "part", "fp", "text").mapInArrow(_judge, _JUDGED), "judged")
    ends, found = judged.where("kind = 1"), judged.where("kind = 0")
    least = ends.groupBy("fp", "text").agg(F.min("_id").alias("least"))
    later = ends.join(least, ["fp", "text"]).where("_id > least").select("_pid", "_group", F.lit(COPY).alias("_copy"))
    closed = found.where("not open").groupBy("_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    opened = found.where("open").groupBy("_pid", "_group", "_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(later, ["_pid", "_group"], "left")
    opened = opened.select("_id", "part", F.col("mask").bitwiseOR(F.coalesce("_copy", F.lit(0))).alias("mask"), "n")
    return closed.unionByName(opened).select(F.when(F.col("_id") != _NOBODY, F.col("_id")).alias("doc_id"), "part", "mask", "n")


def count_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail; cells of several runs may be added."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    joined = masks.join(known, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(f"_{x}", F.lit(0))).alias(x) for x in ("good", "toxic")))


def orders_of(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Each part's counts at each step of each order of the filters; `letters` names the bits of the mask from the lowest."""
    bit = {x: 1 << k for k, x in enumerate(letters)}
    steps = [("".join(o), k + 1, sum(bit[x] for x in o[:k]), bit[x]) for o in permutations(letters) for k, x in enumerate(o)]
    states = F.array(*(F.struct(F.lit(b).alias("before"), F.lit(x).alias("bit")) for b, x in sorted({s[2:] for s in steps})))
    each = cells.select("*", F.explode(states).alias("at")).select("part", "mask", "n", "good", "toxic", "at.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda where, name: F.sum(F.when(where, F.col(name)).otherwise(0)).cast("bigint")
    # Of all orders, one in as many as the mask has bits puts the filter first among those that the document fails.
    share = F.expr(f"sum(if((mask & bit) <> 0, n * ({math.factorial(len(letters))} div bit_count(mask)), 0))").cast("bigint")
    counted = each.groupBy("part", "before", "bit").agg(
        total(~fails & ~gone, "n").alias("kept"), total(fails & ~gone, "n").alias("removed"), total(fails & gone, "n").alias("redundant"), total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )
    order = cells.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    return counted.join(order, ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step."""
    scratch = Scratch(docs.sparkSession, "filter_audit")
    cells = scratch.write(count_cells(failure_masks(docs, scratch), labels.select("doc_id", "quality", "toxic")), "cells")
    scratch.drop("judged")
    return orders_of(cells)
