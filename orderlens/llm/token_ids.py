"""Token ids of texts from a public tokenizer file, word by word.

The tokenizers used here drop white space and never join characters across it, so a text's ids are the ids of its words
in order. Each distinct word is encoded once and its ids are copied from then on. Learned words are named by two 64-bit
hashes in flat numpy tables, about 70 bytes a word; the tables are emptied when they hold `CACHE` words, so their memory
is bounded. Where the tokenizer lower-cases, so are the words before they are looked up.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .words import HASH_KEYS, Words

CACHE = 1_000_000
SLOTS = 1 << 21
RUN = 100
END = 2

_loaded: dict[str, "Encoder"] = {}


class HashTable:
    """Positions by 64-bit key with open addressing; many keys are found or put in a few array steps."""

    def __init__(self, slots: int):
        self.keys, self.positions, self.mask = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.uint64(slots - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 if it has none."""
        place, out, left = (keys & self.mask).astype(np.int64), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(left):
            held = self.keys[place[left]]
            hit = held == keys[left]
            out[left[hit]] = self.positions[place[left[hit]]]
            left = left[~hit & (held != 0)]
            place[left] = (place[left] + 1) & int(self.mask)
        return out

    def put(self, keys: np.ndarray, positions: np.ndarray) -> None:
        """Adds keys; one that is there already keeps its position."""
        place, left = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] == 0]
            at, first = np.unique(place[free], return_index=True)
            self.keys[at], self.positions[at] = keys[free[first]], positions[free[first]]
            left = left[self.keys[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & int(self.mask)


class Encoder:
    """Ids of the words of one tokenizer file; one for each worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normalizer = self.tokenizer.normalizer
        self.lower = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.clear()

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = Encoder(path)
        return _loaded[path]

    def clear(self) -> None:
        self.table = HashTable(SLOTS)
        self.known = self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.check = np.zeros(1 << 16, np.uint64)
        self.start = np.zeros(1 << 16, np.int32)
        self.length = np.zeros(1 << 16, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Encode words in runs of `RUN`, joined by spaces; tokens go to the word in which they begin."""
        runs = [words[i : i + RUN] for i in range(0, len(words), RUN)]
        found = self.tokenizer.encode_batch([" ".join(run) for run in runs], add_special_tokens=False)
        ids, lengths = [], []
        for run, each in zip(runs, found, strict=True):
            sizes = np.fromiter(map(len, run), np.int64, len(run)) + 1
            begin = np.array(each.offsets, np.int64).reshape(-1, 2)[:, 0]
            edge = np.searchsorted(begin, np.append(0, np.cumsum(sizes)))
            ids.append(np.array(each.ids, np.uint32))
            lengths.append(np.diff(edge))
        flat, length = np.concatenate(ids), np.concatenate(lengths)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        first = self.known
        while first + len(words) > len(self.start):
            self.start, self.length, self.check = (np.append(x, np.zeros_like(x)) for x in (self.start, self.length, self.check))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[first : first + len(words)] = self.used + np.cumsum(length) - length
        self.length[first : first + len(words)] = length
        self.used += len(flat)
        self.known += len(words)

    def _codes(self, words: Words) -> np.ndarray:
        """The place of each word of the vocabulary in the learned words; new ones are learned."""
        key, check = words.names(*HASH_KEYS)
        key = np.maximum(key, np.uint64(1))
        if self.known + len(key) > CACHE:
            self.clear()
        code = self.table.find(key)
        new = np.flatnonzero((code < 0) | (self.check[np.maximum(code, 0)] != check))
        first = self.known
        for i in range(0, len(new), 20_000):
            self._learn(words.vocabulary.take(pa.array(new[i : i + 20_000])).to_pylist())
        code[new] = first + np.arange(len(new))
        self.check[first : self.known] = check[new]
        room = new[: max(0, CACHE - first)]  # the vocabulary of one very long text may exceed the table
        self.table.put(key[room], code[room].astype(np.int32))
        return code

    def encode(self, column: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and where each text begins (one entry more than texts)."""
        words = Words(column, lower=self.lower)
        code = self._codes(words)[words.ids]
        length = self.length[code].astype(np.int64)
        upto = np.append(0, np.cumsum(length))
        begin = upto[words.first] + np.arange(len(words.count) + 1)
        out = np.empty(begin[-1], np.uint32)
        body = np.ones(len(out), bool)
        out[begin[1:] - 1] = end
        body[begin[1:] - 1] = False
        out[body] = self.flat[np.arange(upto[-1]) + np.repeat(self.start[code] - upto[:-1], length)]
        return out, begin
