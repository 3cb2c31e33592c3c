"""SimHash near-duplicates over tables of distances to reference fingerprints.

A document's fingerprint has 64 bits, each the majority of the XXH64 of its shingles of `SHINGLE` lower-cased words,
repeats included. Fingerprints link at `NEAR` or fewer differing bits. Documents with one fingerprint form a class, and
classes are joined.

Each fingerprint gets its Hamming distances to the references: a base, the base with each single bit turned, and the base
with each byte turned. By the triangle inequality linked fingerprints differ by at most NEAR in every coordinate. Random
references would not do: half of all pairs pass each of them, so pairs must be met before they are discarded. References
that differ from the base in disjoint bits make differences add up: of the 64 coordinates relative to the base, linked
fingerprints differ in at most NEAR. So of `GROUPS` groups of them at least GROUPS - NEAR agree, and fingerprints meet only
under a key of that many groups' coordinates (20 keys of half the table). Pairs that meet are discarded by the maximum
difference of the byte coordinates, and the survivors are verified on their bits.

Links only matter through components, so crowds stay cheap: in star rounds each key's fingerprints meet one of them, the
key's pivot, and what links is merged; then all pairs of different components under a key are met, none left out. The
largest component of a key, mostly the pivot's, is met by the fingerprints outside it only.

Defined cases: null and empty texts have the fingerprint zero, which links like any other; rows may repeat or share an
id; a row without an id gets the least id of its component, or null; an empty table gives no rows; other columns never
take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components, contracted, named
from .scratch import Scratch
from .words import Words, pieces, signed

SHINGLE, SEED, NEAR = 3, 42, 3
GROUPS = 6
BASE = 0x9E3779B97F4A7C15
FINE = [1 << k for k in range(64)]
COARSE = [0xFF << k for k in range(0, 64, 8)]
STAR_ROUNDS = 3
_NOBODY = 2**63 - 1


def simhashes(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text."""
    words = Words(column, lower=True)
    owner, n = words.owner(), len(words.count)
    many = max(0, words.n - SHINGLE + 1)
    start = np.flatnonzero(owner[:many] == owner[SHINGLE - 1 :][:many])
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    last = np.append(start + SHINGLE - 1, words.first[short] + words.count[short] - 1)
    start = np.append(start, words.first[short])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, words.n], pa.int32()), words.vocabulary.cast(pa.string()).take(pa.array(words.ids))), " ")[0].as_buffer().to_pybytes() if words.n else b""
    begin = np.append(0, np.cumsum(words.width + 1))[:-1]
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(begin[start].tolist(), (begin[last] + words.width[last]).tolist(), strict=True)), np.uint64, len(start))
    order = np.argsort(owner[start], kind="stable") if len(short) else np.arange(len(start))
    values, doc = values[order], owner[start][order]
    ones = np.zeros((n, 64), np.int64)
    for at in range(0, len(values), 1 << 16):
        part, of = values[at : at + (1 << 16)], doc[at : at + (1 << 16)]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    most = 2 * ones > np.bincount(doc, minlength=n)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(signed(simhashes(piece.column("text"))))], names=["_id", "fp"])


def _bits(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("bigint")


def distance_table(points: DataFrame) -> DataFrame:
    """(fp, base, fine, coarse): distances to the base, and arrays of those to the base with one bit or one byte turned."""
    to = lambda mask: F.bit_count(F.col("fp").bitwiseXOR(_bits(BASE ^ mask))).cast("tinyint")
    return points.select("fp", to(0).alias("base"), *(to(m).alias(f"f{k}") for k, m in enumerate(FINE)), *(to(m).alias(f"c{k}") for k, m in enumerate(COARSE)))


def keyed(table: DataFrame) -> DataFrame:
    """(key, fp, c0..): a row for each choice of groups; linked fingerprints share a key at least."""
    coarse = [f"c{k}" for k in range(len(COARSE))]
    groups = [F.xxhash64(F.lit(g), *(F.col(f"f{k}") - F.col("base") for k in range(g, len(FINE), GROUPS))).alias(f"g{g}") for g in range(GROUPS)]
    keys = [F.xxhash64(*(F.col(f"g{g}") for g in chosen)) for chosen in combinations(range(GROUPS), GROUPS - NEAR)]
    return table.select("fp", *coarse, *groups).select(F.explode(F.array(*keys)).alias("key"), "fp", *coarse)


def _links(x, y) -> Column:
    """Survivors of the table's maximum difference whose bits are near."""
    table = (F.abs(x(f"c{k}") - y(f"c{k}")) <= NEAR for k in range(len(COARSE)))
    near = F.bit_count(x("fp").bitwiseXOR(y("fp"))) <= NEAR
    for passes in table:
        near = passes & near
    return near


def linked_components(points: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, component) of every fingerprint (fp, distinct) that has a link, or None."""
    every = keyed(distance_table(points))
    twice = scratch.write(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "twice")
    rows = scratch.write(every.join(twice, "key", "left_semi").withColumn("node", F.col("fp")), "rows")
    scratch.drop("twice")
    labels = None
    for step in range(STAR_ROUNDS + 1):
        now = named(rows, labels)
        turn = F.xxhash64("fp", F.lit(step)).alias("turn")
        pivot = F.min(F.struct(turn, "component", "fp", *(f"c{k}" for k in range(len(COARSE)))))
        groups = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), pivot.alias("pivot")).where("low <> high")
        groups = scratch.write(groups.select("key", "pivot"), f"groups-{step}")
        if groups.isEmpty():
            break
        p = F.col("pivot")
        if step < STAR_ROUNDS:
            met = now.join(groups, "key").where((F.col("component") != p["component"]) & _links(F.col, p.getField)).select(F.col("fp").alias("a"), p["fp"].alias("b"))
        else:
            known = now.join(groups.select("key", p["component"].alias("_crowd")), "key").withColumn("outside", F.col("component") != F.col("_crowd"))
            known = scratch.write(known.drop("_crowd", "node"), "known")
            x, y = known.where("outside").alias("x"), known.alias("y")
            once = ~F.col("y.outside") | (F.col("x.fp") < F.col("y.fp"))
            met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & _links(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
            met = met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        found = scratch.write(met.distinct(), f"links-{step}")
        if not found.isEmpty():
            labels = components(found, scratch, f"labels-{step}") if labels is None else contracted(labels, found, scratch, f"labels-{step}")
        scratch.drop(f"groups-{step}", f"links-{step}", "known")
    scratch.drop("rows")
    return labels


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; the fingerprint as 16 hex digits."""
    scratch = Scratch(docs.sparkSession, "simhash_join")
    text = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NOBODY)).alias("_id"), F.col("text").alias("text"))
    scan = scratch.write(text.mapInArrow(_scan, "_id bigint, fp bigint"), "scan")
    classes = scratch.write(scan.groupBy("fp").agg(F.min("_id").alias("least")), "classes")
    labels = linked_components(classes.select("fp"), scratch)
    merged = scratch.write(named(classes.withColumn("node", F.col("fp")), labels).select("fp", "least", "component"), "merged")
    ids = merged.groupBy("component").agg(F.min("least").alias("component_id"))
    known = scratch.write(merged.join(ids, "component").select("fp", "component_id"), "known-ids")
    scratch.drop("classes", "merged")
    out = scan.join(known, "fp")
    id_of = lambda c: F.when(F.col(c) != _NOBODY, F.col(c))
    return out.select(id_of("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_of("component_id").alias("component_id"))
