"""Quality classifier by importance resampling.

Two generative models of hashed words and word pairs, one fitted on target texts (labelled good and not toxic) and one
on all texts, give each document the log of their likelihood ratio. Documents are then sampled without replacement in
proportion to that importance by Gumbel top-k: the k largest values of log weight + standard Gumbel noise stay. (Weights
need not be normalised: a constant changes no order.) k is the number of documents whose weight reaches a cut, the one
that separates labelled target texts from other labelled ones best; so the sample is as large as the target's share of
the corpus, and where weights are close, chance decides.

The raw model counts every document. The target model and the cut are fitted on at most `LABELLED` labelled documents,
the documented bound, drawn by the hash of their id, one text for each id. Log ratios are shrunk by `DEADZONE`, so that chance and the share of
junk in the raw corpus do not add up over long texts.

Defined cases: a null or empty text has weight 0; rows may repeat or share an id, and copies of a document get equal
noise; all documents whose key equals the least one that stays do so too; without usable labels nothing is rejected; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .scratch import Scratch
from .words import Words, mix, pieces

LABELLED = 50_000
WORD_BUCKETS = 1 << 17
PAIR_BUCKETS = 1 << 15
PSEUDO = 4.0
DEADZONE = 1.0
SEED = 17


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all hashed words and pairs of neighbours."""
    value = mix(words.hashes())
    owner = words.owner()
    single = (value & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    pair = mix(value[inside] * np.uint64(3) + value[inside + 1])
    double = (pair & np.uint64(PAIR_BUCKETS - 1)).astype(np.int64) + WORD_BUCKETS
    return np.append(owner, owner[inside]), np.append(single, double)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WORD_BUCKETS + PAIR_BUCKETS, np.int64)
    for piece in pieces(batches, "text"):
        total += np.bincount(grams(Words(piece.column("text"), lower=True))[1], minlength=len(total))
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])


def count_grams(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets; their number is fixed, so the driver gets a bounded table."""
    counts = np.zeros(WORD_BUCKETS + PAIR_BUCKETS)
    for row in texts.select("text").mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["bucket"]] = row["n"]
    return counts


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Shrunk log likelihood ratio of each bucket, words and pairs normalised apart."""
    out = np.zeros(len(raw), np.float32)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, None)):
        t, r = target[part], raw[part]
        expected = r * (t.sum() / max(r.sum(), 1.0))
        ratio = np.log((t + PSEUDO) / (expected + PSEUDO))
        out[part] = np.sign(ratio) * np.maximum(np.abs(ratio) - DEADZONE, 0)
    return out


def _scores(weights, column: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column):
            doc, bucket = grams(Words(piece.column(column), lower=True))
            score = np.bincount(doc, weights=weights.value[bucket], minlength=piece.num_rows).astype(float)  # of no grams it would be whole numbers
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in piece.schema.names if c != column), pa.array(score)], names=[*(c for c in piece.schema.names if c != column), "log_weight"])

    return run


def gumbel(*columns: str) -> Column:
    """Standard Gumbel noise, a function of the columns and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(SEED)), 11) + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(u))


def best_cut(score: np.ndarray, good: np.ndarray) -> float:
    """The cut that separates good from bad with the largest balanced accuracy, in the middle of its gap."""
    order = np.argsort(score, kind="stable")
    score, good = score[order], good[order]
    bad_below = np.append(0, np.cumsum(~good)) / max((~good).sum(), 1)
    good_above = 1 - np.append(0, np.cumsum(good)) / max(good.sum(), 1)
    edge = np.append(True, np.append(score[1:] != score[:-1], True))
    k = int(np.argmax(np.where(edge, bad_below + good_above, -1)))
    if k == 0:
        return float("-inf")
    return float((score[k - 1] + score[min(k, len(score) - 1)]) / 2)


def kth_largest(table: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, by repeated histograms of `bins` rows over the interval that holds it."""
    low, high = table.agg(F.min(key), F.max(key)).first()
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        cell = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        found = table.where(F.col(key).between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for row in sorted(found, key=lambda r: -r["cell"]):
            if k <= row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
        else:
            break
    return low


class Model:
    """Weights, and the least key (log weight + noise) that stays."""

    def __init__(self, docs: DataFrame, labels: DataFrame | None, labelled: int = LABELLED):
        spark = docs.sparkSession
        raw = count_grams(docs)
        sample = None
        self.cut = float("-inf")
        if labels is not None:
            good = (F.min("quality") == 1) & (F.max("toxic") == 0)
            judged = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(good.alias("good"))
            chosen = judged.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(labelled)
            found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
            sample = Scratch(spark, "quality_classifier").write(found, "labelled")
        target = count_grams(sample.where("good")) if sample is not None else raw
        self.weights = spark.sparkContext.broadcast(log_ratios(target, raw))
        if sample is not None:
            rows = sample.select("good", "text").mapInArrow(_scores(self.weights), "good boolean, log_weight double").toPandas()
            if rows["good"].any() and not rows["good"].all():
                self.cut = best_cut(rows["log_weight"].to_numpy(), rows["good"].to_numpy())

    def scored(self, docs: DataFrame) -> DataFrame:
        schema = "doc_id bigint, noise double, log_weight double"
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), gumbel("doc_id").alias("noise"), "text").mapInArrow(_scores(self.weights), schema)
        return rows.withColumn("key", F.col("log_weight") + F.col("noise"))

    def threshold(self, table: DataFrame) -> float:
        """The key of the k-th document, k being the number of documents above the fitted cut."""
        k = table.where(F.col("log_weight") >= F.lit(self.cut)).count()
        return kth_largest(table, "key", k) if k else float("inf")


def classify(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, log_weight, key, kept) for every document."""
    model = Model(docs, labels)
    table = Scratch(docs.sparkSession, "quality_classifier").write(model.scored(docs), "scored")
    return table.withColumn("kept", F.col("key") >= F.lit(model.threshold(table)))


def keep_good(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The documents that the sample keeps, unchanged; they are scored where they lie, without a join."""
    model = Model(docs, labels)
    table = Scratch(docs.sparkSession, "quality_classifier").write(model.scored(docs), "scored")
    least = model.threshold(table)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), gumbel("doc_id").alias("noise"), F.col("text").alias("text"))
    schema = StructType([packed.schema["_row"], packed.schema["noise"], StructField("log_weight", DoubleType())])
    return packed.mapInArrow(_scores(model.weights), schema).where(F.col("log_weight") + F.col("noise") >= F.lit(least)).select("_row.*")
