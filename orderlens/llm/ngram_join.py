"""Jaccard similarity join of documents on word shingles, with adaptive multi-match prefixes.

A document's set holds its distinct shingles of `SHINGLE` lower-cased words; a text with fewer words is one shingle.
Documents with one set form a class, and classes are joined.

Shingles have one global order, rare ones first; rarity comes from a table of bucket counts over all documents. Linked
sets share at least `need` shingles within their prefixes of n - ceil(0.8 n) + need shingles (the multi-match prefix).
Each set chooses its own need: it grows with the estimated number of candidates that the plain prefix would meet, so a
set in a crowd pays a few more prefix rows and is verified against far fewer partners. Of two sets, the smaller need
holds.

Links only matter through components, which keeps crowded prefixes linear:

* star rounds: in each shingle's group the sets are verified against two pivots, and what links is merged. One is drawn
  by a hash, the other is the set with the fewest rarer shingles: the text that the near copies of a crowd were made
  from, or the one closest to it. Sets that meet at the crowd's shingles have few rare ones, so they mostly link with it;
* then all pairs of different components that still share enough prefix shingles are verified, none left out. A pair
  meets once, at its first shared shingle. Places in the prefixes and parity bitmaps of the sets bound how far a pair
  can differ, so most near misses of a crowd are not even paired.

Verification compares whole sets. A shingle is named by a 48-bit hash. A set is named by a 64-bit one; names that two sets
share, told by a second hash of 64 bits, are made anew from both, so a set is known by 128 bits.

Defined cases: null and empty texts have empty sets, are linked with nothing and form components of their own; rows may
repeat or share an id (the component's id is the least id); a row without an id gets the least id of its component, or
null; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .scratch import Scratch
from .words import SpanHashes, Words, mix, pieces, signed

SHINGLE = 5
BUCKETS = 1 << 16
STAR_ROUNDS = 2
NODE_BITS = 64
BITMAP = ["b0", "b1", "b2", "b3"]
BEFORE = 4


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text, 48-bit hash), ordered by both."""
    spans = SpanHashes(words.hashes(), 0)
    owner = words.owner()
    n = words.n - SHINGLE + 1
    start = np.flatnonzero(owner[: max(n, 0)] == owner[SHINGLE - 1 :][: max(n, 0)]) if n > 0 else np.zeros(0, np.int64)
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    doc = np.append(owner[start], short)
    value = np.append(spans.spans(start, np.int64(SHINGLE)), spans.spans(words.first[short], words.count[short]))
    packed = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))  # a run holds fewer than 2^16 texts
    packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
    return (packed >> np.uint64(48)).astype(np.int64), packed << np.uint64(16)


def _signatures(doc: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two independent sums of mixed hashes for each text's set."""
    size = np.bincount(doc, minlength=texts)
    edge = np.append(0, np.cumsum(size))
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.append(np.uint64(0), np.cumsum(mix(value + np.uint64(salt))))
        sums.append(mix(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64)))
    return size, *sums


def _bitmaps(doc: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """For each set 256 parities of its shingles, as 4 words: two sets differ in as many shingles at least as bits."""
    cell = doc * 256 + ((value >> np.uint64(20)) & np.uint64(255)).astype(np.int64)
    odd = (np.bincount(cell, minlength=texts * 256) & 1).astype(np.uint8).reshape(texts, 256)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def _named_sets(doc: np.ndarray, value: np.ndarray, texts: int, bits: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, name and second signature of each text's set; names in `shared` stand for several sets and are made anew."""
    size, node, check = _signatures(doc, value, texts)
    node = node & np.uint64((1 << bits) - 1)
    return size, np.where(np.isin(node, shared), node ^ check, node) if len(shared) else node, check


def _scan(bits: int):
    return lambda batches: _scanned(batches, bits)


def _scanned(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0: id, text hash, size, signature), and bucket counts of the task (kind 1)."""
    loads = np.zeros(BUCKETS, np.int64)
    for piece in pieces(batches, "text"):
        doc, value = shingle_sets(Words(piece.column("text"), lower=True))
        size, node, check = _named_sets(doc, value, piece.num_rows, bits, np.zeros(0, np.uint64))
        loads += np.bincount((value >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(piece.num_rows, np.int8)), piece.column("_id"), piece.column("_text"), pa.array(size.astype(np.int64)), pa.array(signed(node)), pa.array(signed(check)), *(pa.array(b) for b in np.ascontiguousarray(_bitmaps(doc, value, piece.num_rows).T))], names=["kind", "_id", "_text", "n", "node", "check", *BITMAP])
    full = np.flatnonzero(loads)
    nothing = pa.array(np.zeros(len(full), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(full), np.int8)), pa.array(full), pa.array(loads[full]), *([nothing] * 7)], names=["kind", "_id", "_text", "n", "node", "check", *BITMAP])


def crowding(loads: np.ndarray) -> np.ndarray:
    """A level for each bucket: 0 where its count is what chance gives, else about twice the logarithm of the excess."""
    usual = float(np.median(loads)) if len(loads) else 0.0
    excess = loads - (usual + 5 * np.sqrt(usual) + 1)
    return np.where(excess > 0, 1 + np.floor(2 * np.log2(np.maximum(excess, 1) + 1)), 0).astype(np.uint8)


def overlap_floor(n):
    """Shingles that a linked partner shares at least: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def base_need(n):
    """The least need of a set of n shingles."""
    return np.minimum(overlap_floor(n), 1 + n // 32)


def _prefixes(levels: np.ndarray, bits: int, shared: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            doc, value = shingle_sets(Words(piece.column("text"), lower=True))
            size, node, _ = _named_sets(doc, value, piece.num_rows, bits, shared)
            level = levels[(value >> np.uint64(48)).astype(np.int64)]
            crowded = np.flatnonzero(level)
            crowded = crowded[np.lexsort((value[crowded], level[crowded], doc[crowded]))]
            order = np.append(np.flatnonzero(level == 0), crowded)
            order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
            doc, value, level = doc[order], value[order], level[order]
            begin = np.cumsum(size) - size
            rank = np.arange(len(doc)) - begin[doc]
            floor = overlap_floor(size)
            plain = size - floor + 1
            cost = np.bincount(doc[rank < plain[doc]], weights=2.0 ** (level[rank < plain[doc]].astype(float) / 2) - 1, minlength=len(size))
            need = np.minimum(floor, base_need(size) + np.floor(np.log2(1 + cost) / 2).astype(np.int64))
            once = np.zeros(len(size), bool)
            once[np.unique(node, return_index=True)[1]] = True
            take = (rank < (size - floor + need)[doc]) & once[doc]
            doc = doc[take]
            yield pa.RecordBatch.from_arrays([pa.array(signed(value[take])), pa.array(signed(node[doc])), pa.array(size[doc].astype(np.int32)), pa.array(need[doc].astype(np.int32)), pa.array(rank[take].astype(np.int32))], names=["token", "node", "n", "need", "rank"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for piece in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array([press.compress(t.encode()) for t in piece.column("text").to_pylist()], pa.binary())], names=["node", "text"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with packed texts; whether their sets are linked."""
    unpack = zstandard.ZstdDecompressor()
    for piece in pieces(batches, "ta", 1 << 20):
        a, b = piece.column("a").to_numpy(), piece.column("b").to_numpy()
        nodes, where = np.unique(np.append(a, b), return_index=True)
        packed = [*piece.column("ta"), *piece.column("tb")]
        texts = pa.array([unpack.decompress(packed[i].as_py()).decode() for i in where], pa.large_string())
        doc, value = shingle_sets(Words(texts, lower=True))
        edge = np.searchsorted(doc, np.arange(len(nodes) + 1))
        linked = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(np.searchsorted(nodes, a), np.searchsorted(nodes, b), strict=True)):
            x, y = value[edge[i] : edge[i + 1]], value[edge[j] : edge[j + 1]]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                linked[k] = 100 * both >= 80 * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(linked)], names=["a", "b", "linked"])


def _may_link(x, y, need: Column | int) -> Column:
    """Whether two prefix rows can be the last of the first `need` shared shingles of linked sets.

    Linked sets share at least a = ceil(4/9 (n + m)) shingles, so of their `need` first shared ones each has at most
    n - a unshared ones and need - 1 shared ones before it, in either set.
    """
    spare = F.floor(((x("n") + y("n")) * 4 + 8) / F.lit(9.0)).cast("int") - need
    return (x("n") * 5 >= y("n") * 4) & (y("n") * 5 >= x("n") * 4) & (x("rank") + spare < x("n")) & (y("rank") + spare < y("n"))


class _Join:
    """One run of the join; the tables of each step are written, and dropped when nothing reads them any more."""

    def __init__(self, docs: DataFrame, bits: int = NODE_BITS):
        self.bits = bits
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "ngram_join")
        self.text = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("_id"), F.xxhash64("text").alias("_text"), F.col("text").alias("text"))

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """A row for each document, and the classes (node, least, at, component); the component is named by a node."""
        write = self.scratch.write
        scan = write(self.text.mapInArrow(_scan(self.bits), "kind tinyint, _id bigint, _text bigint, n bigint, node bigint, check bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint"), "scan")
        loads = np.zeros(BUCKETS, np.int64)
        for row in scan.where("kind = 1").groupBy("_id").agg(F.sum("_text").alias("n")).collect():  # BUCKETS rows at most
            loads[row["_id"]] = row["n"]
        sets = scan.where("kind = 0")
        full = sets.where("n > 0")
        of = lambda rows: rows.groupBy("node").agg(F.min("_id").alias("least"), F.min(F.struct("_id", "_text")).alias("at"), F.min("check").alias("low"), F.max("check").alias("high"), *(F.min(b).alias(b) for b in BITMAP))
        classes = write(of(full), "classes")
        # Names of several sets: n^2 / 2^65 of n sets, 3 of 10 billion.
        shared = [r["node"] for r in classes.where("low <> high").select("node").collect()]
        if shared:
            sets = sets.withColumn("node", F.when(F.col("node").isin(shared), F.col("node").bitwiseXOR(F.col("check"))).otherwise(F.col("node")))
            classes = write(of(sets.where("n > 0")), "classes-anew")
        prefixes = self.text.where("text is not null").select("text").mapInArrow(_prefixes(crowding(loads), self.bits, np.array(shared, np.int64).view(np.uint64)), "token bigint, node bigint, n int, need int, rank int")
        prefixes = write(prefixes, "prefixes")
        twice = write(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"), "twice")
        shared = write(prefixes.join(twice, "token", "left_semi"), "shared")
        low = F.ceil(F.col("n") * 0.8).cast("int")
        enough = F.least(F.floor((low * 4 + 4) / 5), 1 + F.floor(low / 32))
        able = shared.groupBy("node").agg(F.countDistinct("token").alias("k"), F.first("n").alias("n")).where(F.col("k") >= enough).select("node")
        able = write(able, "able")
        rows = write(shared.join(able, "node", "left_semi").distinct(), "rows")
        self.scratch.drop("prefixes", "twice", "shared")
        wanted = able.join(classes, "node").select("node", "at._id", "at._text")
        self.bitmaps = classes.select("node", *BITMAP)
        texts = self.text.join(wanted, ["_id", "_text"]).dropDuplicates(["node"]).select("node", "text")
        self.texts = write(texts.mapInArrow(_pack, "node bigint, text binary"), "texts")
        labels = self.links(rows)
        merged = write(_named(classes.select("node", "least", "at"), labels), "merged")
        self.scratch.drop("classes", "classes-anew", "able", "rows", "texts")
        return sets, merged

    def run(self) -> DataFrame:
        sets, merged = self.classes()
        ids = self.scratch.write(merged.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
        named = self.scratch.write(merged.join(ids, "component").select("node", "component_id"), "named")
        out = sets.where("n > 0").join(named, "node").select("_id", "_text", "n", "component_id").unionByName(sets.where("n = 0").select("_id", "_text", "n", F.col("_id").alias("component_id")))
        return out

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        first = self.texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        second = self.texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return self.scratch.write(pairs.join(second, "b").join(first, "a").mapInArrow(_verify, "a bigint, b bigint, linked boolean"), name)

    def links(self, rows: DataFrame) -> DataFrame | None:
        """(node, component) of every set that has a link, or None; all links are followed."""
        labels = tested = None
        for step in range(STAR_ROUNDS + 1):
            # Tokens that still join different components, with this round's pivots.
            named, turn = _named(rows, labels), F.xxhash64("node", F.lit(step)).alias("turn")
            row = F.struct("node", "n", "need", "component", "rank").alias("row")
            groups = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(turn, row)).alias("drawn"), F.min(F.struct("rank", turn, row)).alias("central")).where("low <> high")
            groups = self.scratch.write(groups.select("token", F.array_distinct(F.array("drawn.row", "central.row")).alias("pivots")), f"groups-{step}")
            if groups.isEmpty():
                break
            last = step == STAR_ROUNDS
            pairs = self.all_pairs(named, groups) if last else self.pivot_pairs(named, groups)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            done = self.verified(pairs, f"tested-{step}")
            tested = done.select("a", "b") if tested is None else tested.unionByName(done.select("a", "b"))
            labels = self.merged(labels, done.where("linked").select("a", "b"), step)
            self.scratch.drop(f"groups-{step}")
        return labels

    def pivot_pairs(self, named: DataFrame, groups: DataFrame) -> DataFrame:
        """Each set with the pivots that it shares a third of the needed prefix tokens with."""
        p = F.col("pivot")
        need = F.least("need", p["need"])
        near = named.join(groups.select("token", F.explode("pivots").alias("pivot")), "token").where((F.col("component") != p["component"]) & _may_link(F.col, p.__getitem__, need))
        pairs = near.select(F.least("node", p["node"]).alias("a"), F.greatest("node", p["node"]).alias("b"), need.alias("need"))
        return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.min("need").alias("need")).where("3 * k >= need").select("a", "b")

    def all_pairs(self, named: DataFrame, groups: DataFrame) -> DataFrame:
        """Every pair of sets of different components that shares enough prefix tokens.

        A pair meets at its first shared token only: rows carry the `BEFORE` tokens before their own, and two rows with
        one of these in common have met before. As the first shared token of linked sets comes early in both, later
        rows are not paired. At each token the component with the most sets, which holds the crowd, is met by the sets
        outside it only. The pairs then count what their whole prefixes share.
        """
        write = self.scratch.write
        sizes = named.join(groups.select("token"), "token").groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
        crowds = sizes.groupBy("token").agg(F.max(F.struct("k", "component")).alias("most")).select("token", F.col("most.component").alias("_crowd"))
        known = named.join(crowds, "token")
        held = known.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "need", "component")), F.array_sort(F.collect_list(F.struct("rank", "token", (F.col("component") != F.col("_crowd")).alias("outside")))).alias("held"))
        sets = write(held.join(self.bitmaps, "node"), "sets")
        before = lambda x, i: F.struct(x["rank"].alias("rank"), x["token"].alias("token"), x["outside"].alias("outside"), F.slice("tokens", F.greatest(i - BEFORE + 1, F.lit(1)), F.least(i, F.lit(BEFORE))).alias("before"))
        each = sets.withColumn("tokens", F.col("held.token")).select("node", "n", "component", *BITMAP, F.explode(F.transform("held", before)).alias("own"))
        marked = write(each.select("node", "n", "component", *BITMAP, "own.*"), "marked")
        x, y = marked.where("outside").alias("x"), marked.alias("y")
        differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in BITMAP[1:]), F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))))
        once = ~F.col("y.outside") | (F.col("x.node") < F.col("y.node"))
        match = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & once & _may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), 1) & (differ * 9 <= F.col("x.n") + F.col("y.n")) & ~F.arrays_overlap("x.before", "y.before")
        met = x.join(y, match).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        prefix = sets.select("node", "need", F.col("held.token").alias("tokens"))
        first, second = prefix.toDF("a", "need_a", "tokens_a"), prefix.toDF("b", "need_b", "tokens_b")
        enough = F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.least("need_a", "need_b")
        return met.join(second, "b").join(first, "a").where(enough).select("a", "b")

    def merged(self, labels: DataFrame | None, links: DataFrame, step: int) -> DataFrame | None:
        """Labels after more links; links are contracted to the present components first."""
        if links.isEmpty():
            return labels
        write = self.scratch.write
        if labels is None:
            return components(links, self.scratch, f"labels-{step}")
        for end in ("a", "b"):
            links = links.join(labels.toDF(end, f"{end}_component"), end, "left").withColumn(end, F.coalesce(f"{end}_component", end)).select("a", "b")
        found = components(links.where("a <> b").distinct(), self.scratch, f"found-{step}")
        renamed = labels.join(found.toDF("component", "_to"), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        return write(renamed.unionByName(found.join(labels, "node", "left_anti")), f"labels-{step}")


def _named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the component of their node: its label, or itself."""
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicate_components(docs: DataFrame, bits: int = NODE_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; fewer `bits` make sets share names, for tests."""
    nobody = F.lit(2**63 - 1)
    found = _Join(docs.select("doc_id", "text"), bits).run()
    return found.select(F.when(F.col("_id") != nobody, F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component_id") != nobody, F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the least id, then the least text hash, and of equal rows one.

    Components are told apart by their sets, so a shared or missing id joins none; rows without an id come last.
    Documents without words are all kept. All columns come back unchanged.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("_id"), F.xxhash64("text").alias("_text"))
    sets, merged = _Join(docs.select("doc_id", "text")).classes()
    stay = merged.groupBy("component").agg(F.min("at").alias("at")).select("at._id", "at._text")
    empty = sets.where("n = 0").select("_id", "_text").distinct()
    kept = keyed.join(stay.withColumn("_one", F.lit(True)).unionByName(empty.withColumn("_one", F.lit(False))), ["_id", "_text"])
    one = kept.where("_one").groupBy("_id", "_text").agg(F.first("_row").alias("_row")).select("_row")
    return one.unionByName(kept.where("not _one").select("_row")).select("_row.*")
