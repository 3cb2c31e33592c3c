"""Document fingerprints from prefix polynomial hashes.

A text's code points are read as digits of a polynomial modulo the prime 2^31 - 1. Prefix sums of the terms give the
hash of any span by one subtraction and one product with a power, so span equality costs two lookups and the longest
common extension of two positions a binary search (`PrefixHashes`).

A fingerprint keeps a sample of the prefix array: the length, two whole-text hashes, and up to `ANCHORS` anchors, which
are the places of the least window hashes (`WINDOW` code points) and the text's two ends, each with the prefix hash up
to it. Equal content has equal anchors. `likeness` aligns the anchors of two fingerprints, finds by binary search over
span equality how far each alignment extends, and returns the share of both texts in these common extents. Extents are
known to the distance between anchors, about 1/`ANCHORS` of a long text; a shared passage without two anchors is not seen,
and a window that a text repeats is an anchor at its first place only.

Defined cases: a null text counts as empty; equal texts have equal fingerprints and likeness 1; texts are padded with a
sentinel at both ends, so texts shorter than a window have anchors too; rows with equal ids are ordered by text; an
empty table gives an empty result. Other columns of the input are ignored. Texts are read in blocks, so memory does not
grow with the longest text beyond its code points.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .words import mix

PRIME = np.uint64(2**31 - 1)
BASES = (1_000_003, 69_069_069)
WINDOW = 16
ANCHORS = 64
BLOCK = 1 << 16

_31 = np.uint64(31)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^63."""
    x = (x & PRIME) + (x >> _31)
    x = (x & PRIME) + (x >> _31)
    return np.where(x >= PRIME, x - PRIME, x)


def _power_table(base: int, n: int) -> np.ndarray:
    table = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        table[done : done + step] = _reduce(table[:step] * np.uint64(pow(base, done, int(PRIME))))
        done += step
    return table


class _Tables:
    """Powers and inverse powers of both bases, grown on demand."""

    def __init__(self):
        self.size = 0

    def get(self, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if n > self.size:
            self.size = 1 << max(BLOCK.bit_length(), int(n).bit_length())
            self.up = [_power_table(b, self.size) for b in BASES]
            self.down = [_power_table(pow(b, -1, int(PRIME)), self.size) for b in BASES]
        return self.up, self.down


_tables = _Tables()


def code_points(text: str) -> np.ndarray:
    """Code points plus one, so that 0 is free for padding."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class PrefixHashes:
    """Modular prefix arrays of one text under both bases."""

    def __init__(self, text: str):
        self.points = code_points(text)
        n = len(self.points)
        up, self._down = _tables.get(n + 1)
        self.prefix = []
        for k in range(2):
            terms = np.zeros(n + 1, np.uint64)
            terms[1:] = _reduce(self.points * up[k][:n])
            for i in range(1, n + 1, BLOCK):  # sums of a block fit in 64 bits
                part = terms[i - 1 : i + BLOCK]
                terms[i - 1 : i + BLOCK] = _reduce(np.cumsum(part))
            self.prefix.append(terms)

    def __len__(self) -> int:
        return len(self.points)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hashes of the code points from start up to end."""
        return tuple((int(p[end]) - int(p[start])) % int(PRIME) * int(d[start]) % int(PRIME) for p, d in zip(self.prefix, self._down, strict=True))

    def equal(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def common_extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common prefix of self[i:] and other[j:], by binary search over span equality."""
        low, high = 0, min(len(self) - i, len(other) - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _lowest(key: np.ndarray, place: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The `keep` smallest distinct keys, sorted, each with its first place; places ascend."""
    if len(key) > 16 * keep:
        limit = (4 * keep << 32) // len(key)
        while limit < 1 << 32:
            few = key <= limit
            if len(np.unique(key[few])) >= keep:
                key, place = key[few], place[few]
                break
            limit *= 4
    key, first = np.unique(key, return_index=True)
    return key[:keep], place[first[:keep]]


class Fingerprint:
    """Length, whole-text hashes, and anchors in order of place: window key, place in the padded text, prefix hash."""

    def __init__(self, n: int, whole: tuple[int, int], key: np.ndarray, place: np.ndarray, prefix: np.ndarray):
        self.n, self.whole, self.key, self.place, self.prefix = n, whole, key, place, prefix

    def __str__(self) -> str:
        body = np.concatenate([self.key, self.place, self.prefix]).astype(">u4").tobytes()
        return f"{self.n:x}-{self.whole[0]:08x}{self.whole[1]:08x}-{base64.b64encode(body).decode()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, body = text.split("-")
        parts = np.frombuffer(base64.b64decode(body), ">u4").astype(np.int64).reshape(3, -1)
        return cls(int(n, 16), (int(whole[:8], 16), int(whole[8:], 16)), *parts)

    def limit(self) -> int:
        """Keys above it may be missing; the anchors at the ends are always there."""
        inner = self.key[1:-1]
        return int(inner.max()) if len(inner) >= ANCHORS - 2 else 1 << 32


def fingerprint(text: str) -> Fingerprint:
    points = code_points(text)
    n = len(points)
    padded = np.zeros(n + 2 * (WINDOW - 1), np.uint64)
    padded[WINDOW - 1 : WINDOW - 1 + n] = points
    up, down = _tables.get(BLOCK + WINDOW)
    whole, windows = [0, 0], len(padded) - WINDOW + 1
    key = place = np.zeros(0, np.int64)
    found: dict[int, int] = {}  # prefix hashes at places that may become anchors
    ends = {}
    for at in range(0, windows, BLOCK):
        block = padded[at : at + BLOCK + WINDOW - 1]
        m = len(block)
        w = m - WINDOW + 1
        for k in range(2):
            terms = _reduce(block * up[k][:m])
            shift = pow(BASES[k], at, int(PRIME))
            if k == 0:
                prefix = np.zeros(m + 1, np.uint64)
                np.cumsum(terms, out=prefix[1:])
                value = _reduce(_reduce(prefix[WINDOW:] - prefix[:w]) * down[0][:w])
                own = (mix(value + np.uint64(1)) >> np.uint64(32)).astype(np.int64)
                key, place = _lowest(np.append(key, own), np.append(place, at + np.arange(w)), ANCHORS - 2)
                if at == 0:
                    ends[0] = (int(own[0]), 0)
                here = place[place >= at]
                if at + w == windows:
                    ends[1] = (int(own[-1]), windows - 1)
                    here = np.append(here, windows - 1)
                found |= {int(p): (whole[0] + int(prefix[p - at]) % int(PRIME) * shift) % int(PRIME) for p in here}
            whole[k] = (whole[k] + int(terms[:BLOCK].sum()) % int(PRIME) * shift) % int(PRIME)
    found[0] = 0
    order = np.argsort(place)
    key, place = key[order], place[order]
    inner = (place > 0) & (place < windows - 1)
    key = np.concatenate([[ends[0][0]], key[inner], [ends[1][0]]])
    place = np.concatenate([[0], place[inner], [windows - 1]])
    return Fingerprint(n, (whole[0], whole[1]), key, place, np.array([found[int(p)] for p in place], np.int64))


def common_extents(a: Fingerprint, b: Fingerprint) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of padded spans in common: aligned anchors, extended by binary search."""
    low = min(a.limit(), b.limit())
    own = np.flatnonzero((a.key <= low) | (a.place == 0) | (a.place == a.place[-1]))
    order = np.argsort(b.key, kind="stable")
    at = np.minimum(np.searchsorted(b.key[order], a.key[own]), len(order) - 1)
    hit = b.key[order[at]] == a.key[own]
    i, j = own[hit], order[at[hit]]
    if not len(i):
        return []
    shift = b.place[j] - a.place[i]
    out, k, prime = [], 0, int(PRIME)
    cuts = np.append(np.flatnonzero(shift[1:] != shift[:-1]) + 1, len(i)).tolist()
    for stop in cuts:
        # Anchors k to stop - 1 lie at one shift; each step takes the longest equal stretch from k on.
        d = int(shift[k])
        power = pow(BASES[0], abs(d), prime)
        pa, pb = (a.prefix[i[k:stop]] * power % prime, b.prefix[j[k:stop]]) if d >= 0 else (a.prefix[i[k:stop]], b.prefix[j[k:stop]] * power % prime)
        base, first, count = k, 0, stop - k
        while first < count:
            low_, high = first, count - 1
            while low_ < high:
                middle = (low_ + high + 1) // 2
                if (pa[middle] - pa[first] - pb[middle] + pb[first]) % prime == 0:
                    low_ = middle
                else:
                    high = middle - 1
            out.append((int(a.place[i[base + first]]), int(b.place[j[base + first]]), int(a.place[i[base + low_]] - a.place[i[base + first]]) + WINDOW))
            first = low_ + 1
        k = stop
    return out


def _covered(spans: list[tuple[int, int]], n: int) -> int:
    """Code points of the text in the padded spans (begin, end)."""
    total, done = 0, 0
    for begin, end in sorted(spans):
        begin, end = max(begin - WINDOW + 1, done), min(end - WINDOW + 1, n)
        if end > begin:
            total += end - begin
            done = end
    return total


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of both texts in common extents: 2 * common / (length + length), 0 to 1."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    spans = common_extents(a, b)
    common = min(_covered([(x, x + n) for x, _, n in spans], a.n), _covered([(y, y + n) for _, y, n in spans], b.n))
    return 2 * common / (a.n + b.n)


def _bucket(column: Column, bounds: list) -> Column:
    """How many bounds are at or below the column, by a balanced tree of comparisons."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column < F.lit(bounds[middle]), pick(low, middle)).otherwise(pick(middle + 1, high))

    return pick(0, len(bounds))


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by bucket, document, text; `_copy` marks the next bucket's first document, which closes a bucket."""
    last = None
    for batch in batches:
        rows = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        for bucket, copy, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = fingerprint(text)
            if last is not None and last[0] == bucket:
                _, ended, before, words, mark = last
                if ended:
                    continue
                cut = len(words) // 4
                edited = words[: len(words) - cut] + text[:cut]
                changed = fingerprint(edited)
                rows["doc_id"].append(before)
                rows["n_chars"].append(len(words))
                rows["edited_sha256"].append(hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
                rows["fingerprint"].append(str(mark))
                rows["edited_fingerprint"].append(str(changed))
                rows["near_edited"].append(likeness(mark, changed))
                rows["near_next"].append(likeness(mark, own))
            last = (bucket, copy, doc, text, own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["n_chars"], pa.int64()), *(pa.array(rows[k], pa.string()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(pa.array(rows[k], pa.float64()) for k in ("near_edited", "near_next"))],
            names=list(rows),
        )


def fingerprint_neighbours(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with each other and with the next document's.

    Documents are dealt into ranges of doc_id. The first document of each range also travels, as a copy, to the range
    before it, so every document meets its successor without an order over the whole table. The driver holds one bound
    and one first id for each range. Documents without an id come first, as in Spark's order.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    bounds = rows.select(order.alias("o")).approxQuantile("o", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    bounds = sorted({int(b) for b in bounds})
    rows = rows.select(_bucket(order, bounds).alias("_bucket"), "doc_id", order.alias("_order"), "text")
    heads = sorted((r["_bucket"], r["o"]) for r in rows.groupBy("_bucket").agg(F.min("_order").alias("o")).collect())
    before = F.lit(None).cast("int")
    for k, (_, head) in enumerate(heads):
        before = F.when(F.col("_order") == F.lit(head), F.lit(heads[k - 1][0])).otherwise(before) if len(heads) < 64 else before
    if len(heads) >= 64:
        pairs = spark.createDataFrame([(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)], "_order bigint, _to int")
        copies = rows.join(F.broadcast(pairs), "_order").select(F.col("_to").alias("_bucket"), F.lit(True).alias("_copy"), "doc_id", "text")
    else:
        copies = rows.where(F.col("_order").isin([h for _, h in heads])).select(before.alias("_bucket"), F.lit(True).alias("_copy"), "doc_id", "text")
    dealt = rows.select("_bucket", F.lit(False).alias("_copy"), "doc_id", "text").unionByName(copies)
    return dealt.repartitionById(buckets, F.col("_bucket")).sortWithinPartitions("_bucket", "_copy", "doc_id", "text").mapInArrow(_compare, _OUT)
