"""Binary output of token ids by a static range asymmetric numeral system.

Documents are written in ascending id order. A block holds whole documents, about `BLOCK_IDS` ids, coded by up to
`LANES` interleaved states, so each coding step is a handful of array operations. The blocks of a segment share one
frequency table, made from the segment's own ids before they are coded. Every block can be decoded alone, and from any
of its checkpoints (the states and the place in the word stream at every `CHECKPOINT`-th step); a CRC-32 guards its
payload.

The container is a folder of Parquet files written by Spark's committed writer, one row for each block: part, block,
first (ids of the part before it), doc_ids, lengths, table, payload, crc. A block's payload is a header of six unsigned
32-bit little-endian integers (lanes, ids, precision, words, checkpoints, checkpoint interval), the words in decoding
order, and for each checkpoint its place in the words followed by its 64-bit states.

Defined cases: a null text counts as empty and yields the end id alone; rows with equal ids are ordered by the text's
hash, then by the text, and may be dealt to several parts; an empty table writes no blocks; documents without an id come
first; other columns never take part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .token_ids import Encoder
from .words import pieces

PRECISION = 18
LANES = 1024
BLOCK_IDS = 1 << 17
SEGMENT_IDS = 1 << 21
CHECKPOINT = 64
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_HEAD = struct.Struct("<6I")

LAYOUT = "part int, block int, first bigint, doc_ids array<bigint>, lengths array<int>, table binary, payload binary, crc bigint"


class Table:
    """Frequencies of the ids that occur, scaled to 2^PRECISION, each at least 1."""

    def __init__(self, symbols: np.ndarray, frequency: np.ndarray):
        self.symbols, self.frequency = symbols, frequency.astype(np.uint64)
        self.start = np.cumsum(self.frequency) - self.frequency

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        symbols, counts = np.unique(ids, return_counts=True)
        total = 1 << PRECISION
        if len(symbols) > total:
            raise ValueError("more distinct ids than the precision can hold")
        frequency = np.maximum(1, counts * (total - len(symbols)) // max(1, counts.sum()))
        frequency[np.argmax(counts)] += total - frequency.sum()
        return cls(symbols.astype(np.uint32), frequency)

    def pack(self) -> bytes:
        return struct.pack("<I", len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.frequency.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        (n,) = struct.unpack_from("<I", data)
        return cls(np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, "<u4", n, 4 + 4 * n))

    def slots(self) -> np.ndarray:
        """Which symbol each slot of the range stands for, by index."""
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.frequency.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    lanes = max(1, min(LANES, len(ids) // 64))
    index = np.searchsorted(table.symbols, ids)
    frequency, start = table.frequency[index], table.start[index]
    limit = frequency << np.uint64(63 - PRECISION)
    state = np.full(lanes, _LOW)
    steps = -(-len(ids) // lanes)
    words, marks = [], []
    for step in range(steps - 1, -1, -1):
        part = slice(step * lanes, min(len(ids), (step + 1) * lanes))
        x, f = state[: part.stop - part.start], frequency[part]
        full = x >= limit[part]
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        x = np.where(full, x >> _32, x)
        high = x // f
        state[: len(x)] = (high << np.uint64(PRECISION)) + (x - high * f) + start[part]
        if step % CHECKPOINT == 0:
            marks.append((step, state.copy()))
    sizes = np.cumsum([0, *(len(w) for w in reversed(words))])
    out = [_HEAD.pack(lanes, len(ids), PRECISION, int(sizes[-1]), len(marks), CHECKPOINT), *(w.astype("<u4").tobytes() for w in reversed(words))]
    for step, states in reversed(marks):
        out += [struct.pack("<I", int(sizes[step])), states.astype("<u8").tobytes()]
    return b"".join(out)


def decode_block(payload: bytes, table: Table, slots: np.ndarray, checkpoint: int = 0, last: int | None = None) -> np.ndarray:
    """Ids from a checkpoint up to another, or to the end of the block."""
    lanes, count, precision, n_words, n_marks, interval = _HEAD.unpack_from(payload)
    words = np.frombuffer(payload, "<u4", n_words, _HEAD.size)
    if count == 0:
        return np.zeros(0, np.uint32)
    at = _HEAD.size + 4 * n_words + checkpoint * (4 + 8 * lanes)
    (place,) = struct.unpack_from("<I", payload, at)
    state = np.frombuffer(payload, "<u8", lanes, at + 4).astype(np.uint64)
    first, steps = checkpoint * interval, -(-count // lanes)
    end = steps if last is None else min(steps, last * interval)
    out = np.empty(min(count, end * lanes) - first * lanes, np.uint32)
    mask, shift = np.uint64((1 << precision) - 1), np.uint64(precision)
    for step in range(first, end):
        n = min(count - step * lanes, lanes)
        x = state[:n]
        low = x & mask
        symbol = slots[low.astype(np.int64)]
        x = table.frequency[symbol] * (x >> shift) + low - table.start[symbol]
        short = np.flatnonzero(x < _LOW)
        x[short] = (x[short] << _32) | words[place : place + len(short)].astype(np.uint64)
        place += len(short)
        state[:n] = x
        out[(step - first) * lanes : (step - first) * lanes + n] = symbol
    return table.symbols[out]


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        encoder = Encoder.of(path)
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def segment():
            nonlocal block, first, docs, ids, held
            flat = np.concatenate(ids)
            table = Table.of(flat)
            packed = table.pack()
            lengths = np.array([n for _, n in docs])
            ends = np.cumsum(lengths)
            begin = 0
            rows = []
            while begin < len(docs):
                base = ends[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, base + BLOCK_IDS, "right")))
                payload = encode_block(flat[base : ends[stop - 1]], table)
                rows.append((part, block, first, [d for d, _ in docs[begin:stop]], lengths[begin:stop].tolist(), packed, payload, zlib.crc32(payload)))
                block, first, begin = block + 1, first + int(ends[stop - 1] - base), stop
            docs, ids, held = [], [], 0
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
            names = [x.split()[0] for x in LAYOUT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for piece in pieces(batches, "text", 2 << 20):
            flat, begin = encoder.encode(piece.column("text"))
            docs += zip(piece.column("doc_id").to_pylist(), np.diff(begin).tolist(), strict=True)
            ids.append(flat)
            held += len(flat)
            if held >= SEGMENT_IDS:
                yield segment()
        if docs:
            yield segment()

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str) -> None:
    """Tokenize every text and write its ids to the folder, in ascending order of doc_id over parts and blocks."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.withColumn("_text", F.xxhash64("text")).repartitionByRange("doc_id", "_text")  # splits equal ids too
    ordered = dealt.sortWithinPartitions("doc_id", "_text", "text").select("doc_id", "text")
    ordered.mapInArrow(_write(tokenizer), LAYOUT).write.mode("overwrite").parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = None
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("part", "doc_id", "start", "n_tokens", "ids_crc32")}
        for i in range(batch.num_rows):
            part, first, docs, lengths, packed, payload, crc = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("part", "first", "doc_ids", "lengths", "table", "payload", "crc"))
            if zlib.crc32(payload) != crc:
                raise ValueError(f"part {part}: a block does not match its checksum")
            if known is None or known[0] != packed:
                table = Table.unpack(packed)
                known = (packed, table, table.slots())
            ids = decode_block(payload, known[1], known[2])
            at = 0
            for doc, n in zip(docs, lengths, strict=True):
                rows["part"].append(part)
                rows["doc_id"].append(doc)
                rows["start"].append(first + at)
                rows["n_tokens"].append(n)
                rows["ids_crc32"].append(zlib.crc32(ids[at : at + n].astype("<u4").tobytes()))
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("doc_id", "start", "n_tokens", "ids_crc32"))], names=list(rows))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the folder: for each document its first id's place in the whole, its length, and the CRC-32 of its ids."""
    blocks = spark.read.schema(LAYOUT).parquet(folder)
    sizes = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    base, rows = 0, []
    for row in sizes.orderBy("part").collect():  # a row for each written file
        rows.append((row["part"], base))
        base += row["n"]
    bases = spark.createDataFrame(rows, "part int, base bigint")
    found = blocks.mapInArrow(_read, "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
