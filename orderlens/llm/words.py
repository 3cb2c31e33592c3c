"""Words of Arrow string columns as flat numpy arrays.

A word is a maximal run of ``[^\x20\x09-\x0D]``. Splitting works on UTF-8 bytes: the six separators are ASCII, and no
other character's encoding holds their bytes. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Keys of two independent word hashes.
HASH_KEYS = ("0123456789123456", "fedcba9876543210")

# Odd multipliers of the wrapping 64-bit span hashes; (B - 1) / 2 is odd, so swapped neighbours keep their difference.
_BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each text begins (one entry more than texts)."""
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `limit` bytes of text each; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


class Words:
    """Words of a run of texts: ids into `vocabulary`, and `first[d]`, the index of text d's first word."""

    def __init__(self, col: pa.Array, lower: bool = False):
        data, begin = text_bytes(col)
        if lower:
            data = _LOWER[data]
        solid = ~_SPACE[data]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        edge = begin[:-1][begin[:-1] < len(data)]
        opens[edge] = solid[edge]
        at = np.flatnonzero(opens)
        kept = np.cumsum(solid, dtype=np.int64)
        ends = np.append(kept[at] - 1, kept[-1] if len(kept) else 0)
        self.first = np.searchsorted(at, begin)
        self.count = np.diff(self.first)
        self.n = len(at)
        self.width = np.diff(ends)
        body = pa.py_buffer(np.ascontiguousarray(data[solid]))
        flat = pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(ends), body)
        coded = flat.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary

    def names(self, *keys: str) -> list[np.ndarray]:
        """For each hash key the 64-bit hashes of the vocabulary, the same in every process."""
        if self.n == 0:
            return [np.zeros(0, np.uint64) for _ in keys]
        objects = self.vocabulary.to_numpy(zero_copy_only=False).astype(object)
        return [pd.util.hash_array(objects, hash_key=k, categorize=False) for k in keys]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.names(HASH_KEYS[0])[0][self.ids] if self.n else np.zeros(0, np.uint64)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up = np.full(n, base, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class SpanHashes:
    """Prefix array of a sequence of 64-bit values: hashes of any span in constant time, modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int = 0):
        n = 1 << max(10, int(len(values) + 1).bit_length())
        up, self._down = _powers(_BASES[base], n)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.prefix[1:])

    def spans(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self._down[start] + np.asarray(length).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all windows of `length` values."""
        n = len(self.prefix) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[length:] - self.prefix[:n]) * self._down[:n] + np.uint64(length))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
