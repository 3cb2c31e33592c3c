"""SimHash links, periodic runs and the filter audit against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
import xxhash
from pyspark.sql import functions as F

from orderlens.llm import filter_audit, periodic_runs, queries, simhash_join
from orderlens.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(200)
    out = [None, "", " \n\t", "one", "two words", "a b c", "A B c", text(4000), "x " * 3000, "a b " * 500, "Ä" * 50 + " #"]
    out += [text(rng.randint(30, 150)) for _ in range(25)] + [base] * 5 + [base.upper(), base.lower() + " end"]
    for k in range(60):
        words = base.split()
        for _ in range(k % 4 + 1):
            words[rng.randrange(200)] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out + ["LOUD SHOUTING TEXT " * 40, "same", "same", "same"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, t, ["en", "de", None][i % 3], "s", 0) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, len(rows), 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def components_by_force(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return [root(x) for x in range(n)]


def simhash_by_force(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) > len(values))


def test_simhash_near_dedup(spark, tables):
    prints = [simhash_by_force(t) for t in texts()]
    names = components_by_force(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    found = {r["doc_id"]: r for r in queries.op11_simhash_near_dedup(spark, tables).collect()}
    assert [found[i]["fingerprint"] for i in range(len(prints))] == [f"{p:016x}" for p in prints]
    assert [found[i]["component_id"] for i in range(len(prints))] == names
    assert len(set(names)) < len(set(prints))  # some links are between different fingerprints


def test_simhash_links_of_crowds(spark):
    """Chains, near misses and dense crowds of fingerprints; every link is found whatever bits differ."""
    rng = random.Random(6)
    points = {0, 2**64 - 1}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(20):
            points.add(x)
            for b in rng.sample(range(64), rng.choice([1, 3, 3, 4, 5])):
                x ^= 1 << b
    centre = rng.getrandbits(64)
    points |= {centre ^ sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(300)}
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    names = components_by_force(len(points), lambda a, b: (points[a] ^ points[b]).bit_count() <= 3)
    found = simhash_join.linked_components(spark.createDataFrame([(p,) for p in signed], "fp bigint"), Scratch(spark, "test"))
    label = {r["node"]: r["component"] for r in found.collect()}
    groups = {}
    for p, name in zip(signed, names, strict=True):
        groups.setdefault(name, set()).add(label.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({g for s in groups.values() for g in s}) == len(groups)


def test_distance_table(spark):
    rng = random.Random(7)
    points = [rng.getrandbits(63) for _ in range(50)]
    table = simhash_join.distance_table(spark.createDataFrame([(p,) for p in points], "fp bigint")).collect()
    for row in table:
        assert row["base"] == (row["fp"] ^ simhash_join.BASE).bit_count()
        assert [row[f"f{k}"] for k in range(64)] == [(row["fp"] ^ simhash_join.BASE ^ m).bit_count() for m in simhash_join.FINE]
        assert [row[f"c{k}"] for k in range(8)] == [(row["fp"] ^ simhash_join.BASE ^ m).bit_count() for m in simhash_join.COARSE]


def runs_by_force(words, exponent=4, least=6):
    out, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets():
    rng = random.Random(8)
    for k in range(400):
        word = [rng.randrange(1 + k % 3) for _ in range(rng.randint(0, 60))]
        for _ in range(k % 3):
            at, p = rng.randrange(len(word) + 1), rng.randint(1, 6)
            word[at:at] = [rng.randrange(3) for _ in range(p)] * rng.randint(3, 6)
        assert periodic_runs.runs_of(word) == runs_by_force(word)
        for exponent, least in ((2, 2), (3, 3), (5, 5)):
            assert periodic_runs.runs_of(word, exponent, least) == runs_by_force(word, exponent, least)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_periodic_runs(spark, tables):
    found = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, tables).collect()}
    several = 0
    for i, text in enumerate(texts()):
        words, row = planted(i, text), found[i]
        runs = runs_by_force(words) if len(words) < 2000 or len(set(words)) < 5 else periodic_runs.runs_of([hash(w) for w in words])
        several += len(runs) > 0
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {p for s, n, q in runs for p in range(s + q, s + n)}
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(w for p, w in enumerate(words) if p not in gone).encode()).hexdigest()
    assert several > 5


def test_stretches_lose_no_run(spark):
    """Runs side by side, overlapping, at the ends of texts, and across rows of a batch."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = []
        while len(words) < rng.randint(1, 120):
            words += [rng.choice("abc") for _ in range(rng.randint(0, 9))] if rng.random() < 0.5 else [rng.choice("abcd") for _ in range(rng.randint(1, 9))] * rng.randint(2, 6) + ["d"][: rng.randint(0, 1)]
        rows.append((i, " ".join(words)))
    for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect():
        assert [tuple(x) for x in r["runs"]] == runs_by_force(rows[r["doc_id"]][1].split())


def audit_by_force(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    docs = {}
    for i, t, lang, *_ in rows:
        t, words = t or "", WORD.findall(t or "")
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.setdefault(lang or "", []).append((i, "".join(k for k, v in fails.items() if v)))
    out, shapley = {}, {}
    for part, held in docs.items():
        for order in map("".join, permutations("ABCDE")):
            left = held
            for k, f in enumerate(order):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fail = [d for d in held if f in d[1]]
                out[part, order, k + 1] = (len(left), len(removed), len(fail) - len(removed), sum(d[1] == f for d in held), sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed))
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_filter_audit(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{tables}/labels.parquet").collect()]
    found = audited(queries.op13_filter_audit(spark, tables))
    assert found == audit_by_force(rows, labels)
    assert len(found) == 3 * 600


@pytest.mark.parametrize("tasks", [1, 7, 64])
def test_copies_over_task_boundaries(spark, tasks):
    """A crowd of copies, ties of ids and missing ids, dealt over many tasks."""
    rng = random.Random(tasks)
    crowd = [(rng.choice([None, 5, *range(100)]), rng.choice(["crowd", "crowd", "crowd", "a", None, ""]), rng.choice(["en", None])) for _ in range(500)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(60)] + [(5, 0, 0), (5, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in crowd], "doc_id bigint, text string, lang string, fp int, `my col` int").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        found = audited(filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == audit_by_force(crowd, labels)


def test_new_operators_take_odd_tables(spark):
    """Null and shared ids, empty and very long texts, repeated rows, clashing names, and empty tables."""
    rng = random.Random(10)
    long = " ".join(rng.choice(["w", "x", "yy", "é"]) + str(rng.randrange(3000)) for _ in range(700_000))
    rows = [(None, None), (None, "b"), (3, ""), (3, "same words here"), (3, "same words here"), (4, long), (5, "again " * 20_000), (None, "b")]
    names = "doc_id bigint, text string, lang string, fp int, node int, component int, `key` int, runs int, part string, mask int, _id int, `a b.c` int"
    docs = spark.createDataFrame([(*r, None, 1, 2, 3, 4, 5, "p", 6, 7, 8) for r in rows], names)
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    found = simhash_join.simhash_components(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] if r["component_id"] is not None else -1) for r in found) == [(-1, -1), (-1, -1), (-1, 3), (3, 3), (3, 3), (3, 3), (4, 4), (5, 5)]
    runs = periodic_runs.periodic_runs(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], len(r["runs"])) for r in runs) == [(-1, 0, 0), (-1, 1, 0), (-1, 1, 0), (3, 0, 0), (3, 3, 0), (3, 3, 0), (4, 700_000, 0), (5, 20_000, 1)]
    assert next(r for r in runs if r["doc_id"] == 5)["collapsed"] == "again"
    audit = audited(filter_audit.audit_filters(docs, labels))
    assert audit == audit_by_force([(*r, None) for r in rows], [(3, 1, 0), (None, 1, 1)])
    none = docs.where("false")
    assert simhash_join.simhash_components(none).isEmpty()
    assert periodic_runs.periodic_runs(none).isEmpty()
    assert filter_audit.audit_filters(none, labels.where("false")).isEmpty()
    assert audited(filter_audit.audit_filters(docs, labels.where("false")))["", "ABCDE", 1][4:6] == (0, 0)
