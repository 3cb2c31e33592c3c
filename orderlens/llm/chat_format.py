"""Chat formatting by columnar byte assembly, with a loss mask.

A turn is written as a header with its role, its text and a trailer. Control strings inside texts and roles get a
backslash after their first character, and strings that already look so get one more, which undoes exactly. The bytes of
all turns of a batch are assembled at once: segment lengths, their cumulative offsets and scatter indices are computed
in numpy, and headers, texts and trailers are copied into one preallocated Arrow buffer.

The output has one row for each conversation: conv_id, formatted, and loss, an array of (begin, end) code point spans of
`formatted` that hold assistant texts.

Defined cases: a null text or role counts as empty; turns of a conversation are ordered by turn (nulls first), then role,
then text; repeated turns stay; a conversation without an id is one conversation, kept with a null id; an empty table
gives an empty result; other columns never take part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import text_bytes

# Control strings of common chat templates.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_ESCAPE = "|".join(rf"(?:{re.escape(c[0])}\\*{re.escape(c[1:])})" for c in CONTROLS)
_FIND = re.compile(_ESCAPE)
TURN_LOSS = "assistant"

SCHEMA = "conv_id bigint, n_turns bigint, formatted string, loss array<struct<begin:bigint,end:bigint>>"


def escape(text: str) -> str:
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _FIND.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def escape_role(role: str) -> str:
    """Roles stand on one line of their own."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, begin: np.ndarray, which: np.ndarray | None = None) -> None:
    """Copy segment i (or segment which[i]) of data to out[at[i]:]."""
    length = np.diff(begin)
    first = begin[:-1]
    if which is not None:
        length, first = length[which], first[which]
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + inside] = data[np.repeat(first, length) + inside]


def _points(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Code points of each segment."""
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return lead[begin[1:]] - lead[begin[:-1]]


def assemble(conversation: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted texts of runs of equal `conversation` numbers (0, 1, ...), and each turn's text span in code points."""
    coded = pc.fill_null(roles, "").dictionary_encode()
    role = coded.indices.to_numpy(zero_copy_only=False)
    heads = pa.array([f"{OPEN}{escape_role(r)}\n" for r in coded.dictionary.to_pylist()], pa.string())
    odd = pc.match_substring_regex(pc.fill_null(texts, ""), r"[<\[]").to_numpy(zero_copy_only=False)
    if odd.any():
        texts = pa.array([escape(t or "") if o else t for t, o in zip(texts.to_pylist(), odd, strict=True)], pa.string())
    head, head_at = text_bytes(heads)
    body, body_at = text_bytes(texts)
    tail = np.frombuffer(CLOSE.encode(), np.uint8)
    head_length, body_length = np.diff(head_at)[role], np.diff(body_at)
    total = head_length + body_length + len(tail)
    end = np.cumsum(total)
    start = end - total
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    _scatter(out, start, head, head_at, role)
    _scatter(out, start + head_length, body, body_at)
    out[(end[:, None] - len(tail) + np.arange(len(tail))).ravel()] = np.tile(tail, len(end))
    first = np.searchsorted(conversation, np.arange(conversation[-1] + 1)) if len(conversation) else np.zeros(0, np.int64)
    offsets = np.append(start[first], end[-1] if len(end) else 0)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    head_points, body_points = _points(head, head_at)[role], _points(body, body_at)
    points = head_points + body_points + len(CLOSE)
    before = np.cumsum(points) - points
    begin = before - before[first][conversation] + head_points
    return formatted, begin, begin + body_points


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns come ordered; the last conversation of a batch waits for the next."""

    def done(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        get = lambda c: table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type)
        key = pc.fill_null(get("conv_id"), -(2**63)).to_numpy(zero_copy_only=False)
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        formatted, begin, end = assemble(number, get("role"), get("text"))
        loss = pc.equal(pc.fill_null(get("role"), ""), TURN_LOSS).to_numpy(zero_copy_only=False)
        counts = np.bincount(number[loss], minlength=len(formatted)) if len(key) else np.zeros(0, np.int64)
        spans = pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.StructArray.from_arrays([pa.array(begin[loss]), pa.array(end[loss])], names=["begin", "end"]))
        turns = np.bincount(number, minlength=len(formatted)) if len(key) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([get("conv_id").take(pa.array(np.flatnonzero(new))), pa.array(turns.astype(np.int64)), formatted.cast(pa.string()), spans], names=["conv_id", "n_turns", "formatted", "loss"])

    held: list[pa.RecordBatch] = []  # slices of the conversation that is still open
    for batch in batches:
        if not batch.num_rows:
            continue
        key = pc.fill_null(batch.column(batch.schema.get_field_index("conv_id")), -(2**63)).to_numpy(zero_copy_only=False)
        if held and pc.fill_null(held[-1].column(0).slice(held[-1].num_rows - 1), -(2**63))[0].as_py() != key[0]:
            yield done(pa.Table.from_batches(held))
            held = []
        last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        if last:
            yield done(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield done(pa.Table.from_batches(held))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: its formatted text and the spans under the loss mask."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_format, SCHEMA)


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescape_role(found[1]), unescape(found[2])))
        at = found.end()
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, turns, chars, marked, size = [], [], [], [], []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            read = parse(text)
            n.append(len(read))
            turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in read).encode()).hexdigest())
            learned = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
            chars.append(len(learned))
            marked.append(hashlib.sha256(learned.encode()).hexdigest())
            size.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(marked, pa.string()), pa.array(size, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Read a written output back, and digest its turns and what the loss mask covers."""
    return spark.read.schema(SCHEMA).parquet(folder).mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
