"""Runs of periodic words in each text, found by a suffix automaton.

A run is a stretch of words with smallest period q, at least `EXPONENT` periods and `MIN_LENGTH` words long, that no
neighbouring word extends. The automaton's states are joined bottom-up along suffix links; the ordered set of end
positions of the smaller state goes into the larger one. Two ends that become neighbours in a state are d apart and share
exactly the state's length of words before them; where d is at most that length they seed a square, and where the length
is (exponent - 1) d or more, a run that begins where the shared words begin. Its last pair of ends gives its end.

Only stretches that can hold a run go through the automaton: in a run of period q the three words at a place recur within
q, at all but its last q + 2 places, so a stretch of m such places holds periods up to (m + 2) / (exponent - 1) only. No
run is lost that way.

A text is worked on by itself, so there is no shuffle. Time and memory of a task grow with the words of its longest
periodic stretch, some 1 KB each.

Defined cases: null texts have no words; every row stands for itself, whatever its id; an empty table gives no rows; other
columns never take part.
"""

from __future__ import annotations

from bisect import bisect, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .words import SpanHashes, Words, mix, pieces

EXPONENT, MIN_LENGTH = 4, 6
SHINGLE = 3
BLOCK = 512


class Ends:
    """An ordered set of end positions, in blocks of at most `BLOCK`."""

    def __init__(self, end: int):
        self.blocks, self.lows, self.n = [[end]], [end], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def near(self, x: int) -> tuple[int | None, int | None]:
        """The elements next below and next above x."""
        k = max(0, bisect_right(self.lows, x) - 1)
        block = self.blocks[k]
        j = bisect(block, x)
        above = block[j] if j < len(block) else self.lows[k + 1] if k + 1 < len(self.lows) else None
        return (block[j - 1] if j else None), above

    def add(self, x: int) -> None:
        k = max(0, bisect_right(self.lows, x) - 1)
        block = self.blocks[k]
        block.insert(bisect(block, x), x)
        self.lows[k] = block[0]
        self.n += 1
        if len(block) > BLOCK:
            self.blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
            self.lows.insert(k + 1, block[BLOCK // 2])


def suffix_automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, lengths of the longest strings, and end positions (-1 for states that were split off)."""
    link, longest, end, moves = [-1], [0], [-1], [{}]
    last = 0
    for i, c in enumerate(word):
        new, p = len(link), last
        link.append(0)
        longest.append(i + 1)
        end.append(i)
        moves.append({})
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] > longest[p] + 1:
                split = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                end.append(-1)
                moves.append(dict(moves[q]))
                link[q] = split
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = split
                    p = link[p]
                q = split
            link[new] = q
        last = new
    return link, longest, end


def runs_of(word: list[int], exponent: int = EXPONENT, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    link, longest, end = suffix_automaton(word)
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    far: dict[tuple[int, int], int] = {}  # by start and period: the last word of the run so far
    for state in sorted(range(1, len(link)), key=longest.__getitem__, reverse=True):
        parent = link[state]
        shared = longest[parent]
        limit = shared // (exponent - 1)  # shorter states can seed no run
        small, large, sets[state] = sets[state], sets[parent], None
        if limit < 1 or small is None:
            continue
        if large is None:
            sets[parent] = small
            continue
        if small.n > large.n:
            small, large = large, small
        added = list(small)
        for x in added:  # all of them before any is added: neighbours of one child share more words
            below, above = large.near(x)
            if below is not None and x - below <= limit:
                at = (below - shared + 1, x - below)
                far[at] = max(far.get(at, 0), x)
            if above is not None and above - x <= limit:
                at = (x - shared + 1, above - x)
                far[at] = max(far.get(at, 0), above)
        for x in added:
            large.add(x)
        sets[parent] = large
    found: dict[int, list[tuple[int, int]]] = {}
    for (start, period), stop in sorted(far.items()):
        # A multiple of a run's period seeds inside that run only, and begins with it.
        if not any(period % q == 0 and stop <= end_of for q, end_of in found.get(start, ())):
            found.setdefault(start, []).append((period, stop))
    every = ((s, stop - s + 1, q) for s, held in found.items() for q, stop in held)
    return [r for r in sorted(every, key=lambda r: (r[0], r[2])) if r[1] >= max(min_length, exponent * r[2])]


def periodic_stretches(words: Words, exponent: int = EXPONENT, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """Disjoint stretches (first word, end) that hold every run whole."""
    n, owner = words.n - SHINGLE + 1, words.owner()
    if n <= 0:
        return []
    start = np.flatnonzero(owner[:n] == owner[SHINGLE - 1 :])
    value = mix(SpanHashes(mix(words.ids.astype(np.uint64) + np.uint64(1)), 0).spans(start, np.int64(SHINGLE)) + owner[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(value, kind="stable")
    again = np.flatnonzero(value[order[1:]] == value[order[:-1]])
    gap = np.full(words.n, words.n, np.int64)
    gap[start[order[again]]] = start[order[again + 1]] - start[order[again]]
    marked = gap < words.n
    for _ in range(4):  # each round keeps all runs, and fewer other places
        edges = np.diff(marked.astype(np.int8), prepend=0, append=0)
        first, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        longest_period = (stop - first + SHINGLE - 1) // (exponent - 1)
        longest_period[stop - first < min_length - SHINGLE] = 0
        places = np.flatnonzero(marked)
        marked[places] = gap[places] <= np.repeat(longest_period, stop - first)
    edges = np.diff(marked.astype(np.int8), prepend=0, append=0)
    first, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    stop = np.minimum(stop + (stop - first + SHINGLE - 1) // (exponent - 1) + SHINGLE - 1, words.first[owner[first] + 1]) if len(first) else stop
    out: list[tuple[int, int]] = []
    for a, b in zip(first.tolist(), stop.tolist(), strict=True):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _find(exponent: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            owner, texts = words.owner(), piece.num_rows
            docs, found = [], []
            dropped = np.zeros(words.n + 1, np.int64)
            for a, b in periodic_stretches(words, exponent, min_length):
                for start, length, period in runs_of(words.ids[a:b].tolist(), exponent, min_length):
                    docs.append(owner[a])
                    found.append((a + start - words.first[owner[a]], length, period))
                    dropped[a + start + period] += 1
                    dropped[a + start + length] -= 1
            kept = np.cumsum(dropped[:-1]) == 0
            left = np.bincount(owner[kept], minlength=texts)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(left)).astype(np.int32), words.vocabulary.cast(pa.string()).take(pa.array(words.ids[kept])))
            table = np.array(found, np.int64).reshape(-1, 3)
            held = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(np.array(docs, np.int64), minlength=texts))).astype(np.int32), held)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(words.count.astype(np.int64)), runs, pc.binary_join(lists, " ")], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs (doc_id, text).

    `runs` are ordered by start, then period. `collapsed` holds, joined by single spaces, the words that no run repeats:
    of each run its first period stays.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_find(exponent, min_length), f"doc_id bigint, n_words bigint, runs {_RUNS}, collapsed string")
