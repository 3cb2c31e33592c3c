"""Hierarchical packing of tokenized documents into sequences of several context sizes.

A document first fills whole windows of `WINDOW` tokens. Its rest is routed to the tier of its size. Each tier is packed
from its largest rest down into sequences of the tier's own size: a rest opens a sequence, and its gap is filled from the
same and the shorter tiers, always by the largest rest that fits, and at the end by cutting the smallest one to the gap.
What is left of a task, less than one window, is cut into sequences whose lengths are powers of two, which need no
padding.

A step group has `STEP` windows of tokens. A task deals each tier's sequences to groups of that tier, then those of its
unfilled groups, longest first, to groups of several tiers: as lengths are powers of two, they fill each group to the
token. The sequences of the tasks' last, unfilled groups are dealt across tasks in the same way, in a tree of neighbouring
tasks, so all groups carry equal tokens but the very last one.

Packing runs where the documents lie, without a shuffle of documents. Each task holds one batch, less than a window of
rests, and the places of pieces in one open group for each tier.

Defined cases: a null text counts as empty, the end id alone; rows may repeat or share an id, and each is packed; an
empty table gives an empty result; other columns never take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch
from .token_ids import Encoder
from .words import pieces

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
STEP = 16
GROUP = STEP * WINDOW
ACROSS = 1 << 62  # step groups of several tasks are numbered from here
FAN = 8  # bits: what 256 tasks leave undealt is dealt together

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length int, tier int, step_group bigint"


class Shelf:
    """Rests by length, with the set of lengths as bits so that the largest fit is found at once.

    A tier holds the lengths up to its size that no shorter tier holds.
    """

    def __init__(self):
        self.by_length: list[list] = [[] for _ in range(WINDOW + 1)]
        self.lengths = 0
        self.held = dict.fromkeys(TIERS, 0)

    @property
    def tokens(self) -> int:
        return sum(self.held.values())

    def full(self, tier: int) -> bool:
        """Whether the tier has a rest to open a sequence, and enough tokens up to it to fill the sequence."""
        return self.held[tier] > 0 and sum(n for t, n in self.held.items() if t <= tier) >= tier

    def put(self, rest: tuple) -> None:
        n = rest[2]
        self.by_length[n].append(rest)
        self.lengths |= 1 << n
        self.held[_tier(n)] += n

    def _take(self, n: int) -> tuple:
        held = self.by_length[n]
        rest = held.pop()
        if not held:
            self.lengths &= ~(1 << n)
        self.held[_tier(n)] -= n
        return rest

    def fit(self, room: int) -> tuple | None:
        """The longest rest that fits."""
        found = self.lengths & ((1 << (room + 1)) - 1)
        return self._take(found.bit_length() - 1) if found else None

    def cut(self, room: int) -> tuple | None:
        """The first `room` tokens of the shortest rest; what remains of it goes back."""
        if not self.lengths:
            return None
        doc, start, n, ids, total = self._take((self.lengths & -self.lengths).bit_length() - 1)
        if n <= room:
            return doc, start, n, ids, total
        self.put((doc, start + room, n - room, ids[room:], total))
        return doc, start, room, ids[:room], total

    def fill(self, size: int) -> list[tuple]:
        """Rests for one sequence of `size` tokens."""
        out, room = [], size
        while room:
            rest = self.fit(room) or self.cut(room)
            if rest is None:
                break
            out.append(rest)
            room -= rest[2]
        return out


def _tier(n: int) -> int:
    return next(t for t in TIERS if n <= t)


def _pack(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        base = TaskContext.get().partitionId() << 32
        shelf, made, groups = Shelf(), 0, 0
        rows: list[tuple] = []
        undealt: dict[int, list[tuple]] = {t: [] for t in TIERS}  # (size, rows) of the sequences of each tier's open group
        waiting = dict.fromkeys(TIERS, 0)

        def deal(sequences: list[tuple]) -> None:
            nonlocal groups
            rows.extend((*row, base + groups) for _, own in sequences for row in own)
            groups += 1

        def close(parts: list[tuple]) -> None:
            nonlocal made
            size, offset, own = sum(p[2] for p in parts), 0, []
            tier = _tier(size)
            for doc, start, n, ids, total in parts:
                own.append((doc, start, n, zlib.crc32(ids), total, base + made, offset, size, tier))
                offset += n
            made += 1
            undealt[tier].append((size, own))
            waiting[tier] += size
            if waiting[tier] == GROUP:
                deal(undealt[tier])
                undealt[tier], waiting[tier] = [], 0

        def deal_rest() -> None:
            """Groups of several tiers, longest sequences first; those of an unfilled group get none yet."""
            open_group, tokens = [], 0
            for sequence in sorted((x for t in TIERS for x in undealt[t]), key=lambda x: -x[0]):
                open_group.append(sequence)
                tokens += sequence[0]
                if tokens == GROUP:
                    deal(open_group)
                    open_group, tokens = [], 0
            rows.extend((*row, None) for _, own in open_group for row in own)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 10
            rows.clear()
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for piece in pieces(batches, "text", 2 << 20):
            flat, begin = encoder.encode(piece.column("text"))
            edge = begin.tolist()
            for i, doc in enumerate(piece.column("doc_id").to_pylist()):
                total = edge[i + 1] - edge[i]
                whole = total // WINDOW * WINDOW
                for at in range(0, whole, WINDOW):
                    close([(doc, at, WINDOW, flat[edge[i] + at : edge[i] + at + WINDOW], total)])
                if whole < total:
                    shelf.put((doc, whole, total - whole, flat[edge[i] + whole : edge[i + 1]], total))
            for tier in reversed(TIERS):
                while shelf.full(tier):
                    close(shelf.fill(tier))
            left = []
            while (rest := shelf.fit(WINDOW)) is not None:
                left.append((*rest[:3], rest[3].copy(), rest[4]))  # frees the batch
            for rest in left:
                shelf.put(rest)
            yield flush()
        while shelf.tokens:
            close(shelf.fill(1 << (shelf.tokens.bit_length() - 1)))
        deal_rest()
        yield flush()

    return run


def deal_across(left: DataFrame, scratch: Scratch, fan: int = FAN) -> DataFrame:
    """(sequence_id, step group) of the sequences (sequence_id, sequence_length) that tasks left undealt.

    They are dealt in a tree: of 2^fan neighbouring tasks together, longest first, into full groups; what fills none, less
    than a group, goes on to the next level with that of 2^fan neighbours. A window holds what so many tasks or clusters
    left, less than 2^fan groups, however many tasks there are; only the last group of all may stay unfilled.
    """
    left = scratch.write(left, "left-0")
    tasks = left.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0
    found, level = None, 0
    while level == 0 or tasks >> (fan * level):
        level += 1
        cluster = F.shiftright("sequence_id", 32 + fan * level).alias("cluster")
        order = Window.partitionBy("cluster").orderBy(F.desc("sequence_length"), "sequence_id")
        placed = left.select("sequence_id", "sequence_length", cluster).withColumn("until", F.sum("sequence_length").over(order))
        place = F.floor((F.col("until") - F.col("sequence_length")) / GROUP)
        placed = placed.select("sequence_id", "sequence_length", place.alias("place"), F.sum("sequence_length").over(Window.partitionBy("cluster")).alias("total"), (F.lit(ACROSS) + F.lit(level << 56) + F.col("cluster") * (1 << 28) + place).alias("step_group"))
        placed = scratch.write(placed, f"placed-{level}")
        last = not tasks >> (fan * level)
        full = (F.col("place") + 1) * GROUP <= F.col("total")
        dealt = placed.where(F.lit(last) | full).select("sequence_id", F.col("step_group").alias("_across"))
        found = dealt if found is None else found.unionByName(dealt)
        left = placed.where(~full).select("sequence_id", "sequence_length")
    return found


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and its place there."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    scratch = Scratch(docs.sparkSession, "packing")
    packed = scratch.write(rows.mapInArrow(_pack(tokenizer), SCHEMA), "packed")
    undealt = packed.where("step_group is null").drop("step_group")
    across = deal_across(undealt.select("sequence_id", "sequence_length").distinct(), scratch)
    late = undealt.join(across, "sequence_id").withColumnRenamed("_across", "step_group")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return packed.where("step_group is not null").select(*names).unionByName(late.select(*names))
