"""Quality rules combined by weak supervision.

Each rule votes good (1), votes bad (-1) or abstains (0). Votes are counted by pattern over the whole corpus, at most
3^R patterns, and expectation-maximisation on these counts estimates, without labels, how often each rule votes which
way on good and on bad documents, and the share of good documents. A document's posterior probability of being good
replaces a filter that all rules must pass.

Defined cases: a null text counts as empty: no words, base failed, not kept; an empty table gives an empty result and
no estimate; rows may repeat or share an id; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch
from .words import SpanHashes, Words, mix, pieces, text_bytes

REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
THRESHOLD = 0.5
TRUST = 200.0
_BLANK = " \t\n\x0b\x0c\r"
_ENDS = (".", "!", "?", '"', "”", "…", ":", ";")

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_letters", "n_marks"]


def repeated_words(words: Words, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text in windows that the text holds more than once."""
    n = words.n - window + 1
    if n <= 0:
        return np.zeros(len(words.count), np.int64)
    owner = words.owner()
    start = np.flatnonzero(owner[:n] == owner[window - 1 :])
    value = mix(SpanHashes(mix(words.ids.astype(np.uint64) + np.uint64(1)), 0).spans(start, np.int64(window)) + owner[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(value)
    ranked = value[order]
    same = ranked[1:] == ranked[:-1]
    again = np.append(same, False) | np.append(False, same)
    hit = start[order[again]]
    edges = np.zeros(words.n + 1, np.int64)
    edges[: n] += np.bincount(hit, minlength=n)[:n]
    edges[window : window + n] -= np.bincount(hit, minlength=n)[:n]
    covered = np.append(0, np.cumsum(np.cumsum(edges[:-1]) > 0))
    return covered[words.first[1:]] - covered[words.first[:-1]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    mark = np.zeros(256, bool)
    mark[list(b"!?")] = True
    blank = np.zeros(256, bool)
    blank[list(_BLANK.encode())] = True
    lower = np.zeros(256, bool)
    lower[list(range(97, 123))] = True
    upper = np.zeros(256, bool)
    upper[list(range(65, 91))] = True
    for piece in pieces(batches, "text"):
        column = piece.column("text")
        words = Words(column)
        data, begin = text_bytes(column)

        def total(mask: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(mask, dtype=np.int64))
            return sums[begin[1:]] - sums[begin[:-1]]  # noqa: B023

        lead = data == 0xC3
        high = np.append(lead[:-1] & (data[1:] >= 0x80) & (data[1:] <= 0x9E), False) if len(data) else lead
        dup, lines, ended = [], [], []
        for text in column.to_pylist():
            full = [x for x in (text or "").split("\n") if x.strip(_BLANK)]
            lines.append(len(full))
            dup.append(len(full) - len(set(full)))
            ended.append(sum(x.rstrip(_BLANK).endswith(_ENDS) for x in full))
        values = [words.count, total(~blank[data] & ((data & 0xC0) != 0x80)), total(symbol[data]), np.array(dup), repeated_words(words), np.array(lines), np.array(ended), total(upper[data] | high), total(lower[data] | upper[data] | lead), total(mark[data])]
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in values)], names=["doc_id", *FEATURES])


def measure(docs: DataFrame) -> DataFrame:
    """The counts that the rules read, one row a document."""
    schema = "doc_id bigint, " + ", ".join(f"{f} bigint" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_measure, schema)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes as columns over the counts of `measure`."""
    words, share = F.col("n_words"), lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    long = words >= MIN_WORDS
    return {
        "word_length": _vote(long & ((share("word_chars", "n_words") < 2.5) | (share("word_chars", "n_words") > 12)), long & share("word_chars", "n_words").between(3, 10)),
        "symbols": _vote(share("n_symbols", "n_words") > 0.2, long & (share("n_symbols", "n_words") <= 0.05)),
        "repeats": _vote(share("n_repeat_words", "n_words") > 0.2, long & (share("n_repeat_words", "n_words") <= 0.1)),
        "duplicate_lines": _vote(share("n_dup_lines", "n_lines") > 0.3, (F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0)),
        "case": _vote((F.col("n_letters") >= 20) & (share("n_upper", "n_letters") > 0.4), (F.col("n_letters") >= 20) & (share("n_upper", "n_letters") < 0.15)),
        "marks": _vote(share("n_marks", "n_words") > 0.5, long & (share("n_marks", "n_words") <= 0.1)),
        "line_ends": _vote((F.col("n_lines") >= 3) & (share("n_ended_lines", "n_lines") < 0.1), share("n_ended_lines", "n_lines") >= 0.5),
        "length": _vote(words < MIN_WORDS, words >= 40),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation on counted vote patterns (rows of -1, 0, 1).

    Returns each pattern's posterior of good, the share of good, and alarms[class, rule], the probability that a rule
    which votes votes bad on a bad (0) or good (1) document. An abstention tells nothing, so rules that fire on
    different kinds of junk do not speak against each other where they abstain. It starts from the belief that a single
    bad vote tells more than several good ones; pseudo-votes keep probabilities off 0 and 1, and `TRUST` of them say that
    a rule does not vote bad on good documents. They weigh as much as `TRUST` documents, so that the estimate is free to
    find a rule inaccurate on any larger corpus.
    """
    against, favour = (patterns < 0).astype(float), (patterns > 0).astype(float)
    weight = counts.astype(float)
    good = np.where(against.any(axis=1), 0.1, 0.9)
    prior, alarms = 0.5, np.zeros((2, patterns.shape[1]))
    for _ in range(rounds):
        old = good
        for k, (part, trust) in enumerate(((weight * (1 - good), 0.5), (weight * good, TRUST))):
            alarms[k] = (part @ against + 0.5) / (part @ (against + favour) + 0.5 + trust)
        prior = float(((weight * good).sum() + 1) / (weight.sum() + 2))
        bad_log, good_log = (against @ np.log(a) + favour @ np.log(1 - a) for a in alarms)
        good = 1 / (1 + np.exp(np.clip(bad_log + np.log(1 - prior) - good_log - np.log(prior), -700, 700)))
        if np.abs(good - old).max(initial=0) < 1e-10:
            break
    return good, prior, alarms


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, votes' posterior `quality` and the verdict `kept`, one row a document.

    Documents that fail the base rules are decided and take no part in the estimate.
    """
    votes = rules()
    scratch = Scratch(docs.sparkSession, "quality_rules")
    code = sum(((v + 1) * 3**i for i, v in enumerate(votes.values())), F.lit(0))
    counted = scratch.write(measure(docs).withColumn("pattern", code.cast("int")), "counts")
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    table = counted.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"), F.count_if(~base).alias("open")).collect()  # 3^R rows at most
    codes = np.array([r["pattern"] for r in table], np.int64)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(votes))], axis=1) if len(codes) else np.zeros((0, len(votes)), np.int64)
    quality, _, _ = estimate(patterns, np.array([r["open"] for r in table]))
    known = docs.sparkSession.createDataFrame([(int(c), float(q)) for c, q in zip(codes, quality, strict=True)], "pattern int, quality double")
    out = counted.join(F.broadcast(known), "pattern", "left")
    return out.select("doc_id", *FEATURES, base.alias("base_failed"), F.coalesce(F.col("quality"), F.lit(0.0)).alias("quality"), (~base & (F.coalesce(F.col("quality"), F.lit(0.0)) >= threshold)).alias("kept"))
