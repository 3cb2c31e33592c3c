"""The contract queries of the thirteen operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, filter_audit, fingerprints, ngram_join, packing, periodic_runs, quality_classifier, quality_rules, rans_output, simhash_join, source_mixing, substring_dedup, url_filters
from .scratch import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_word_counts(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "rans_output").path("ids")
    rans_output.write_ids(_table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return rans_output.read_digests(spark, folder)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    folder = Scratch(spark, "chat_format").path("conversations")
    chat_format.format_conversations(turns.unionByName(extra)).write.parquet(folder)
    return chat_format.read_digests(spark, folder)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(_table(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.simhash_components(_table(spark, sf_dir, "documents"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where the id's checksum h ends in 0, the words from place a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    sized = words.withColumn("n", F.size("w")).where("n > 0").withColumn("a", F.col("g") % F.col("n"))
    rest = F.col("n") - F.col("a")
    sized = sized.withColumn("p", F.floor(rest / (F.col("g") % 8 + 3)) + 1)
    tail = F.flatten(F.array_repeat(F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.ceil(rest / F.col("p")).cast("int")))
    edited = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(tail, F.lit(1), rest.cast("int")))
    return sized.select("doc_id", F.array_join(edited, " ").alias("text")).unionByName(words.where("w is null or size(w) = 0").select("doc_id", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_planted_periods(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")))
    # Runs are ordered by start, then period, so that the first of the greatest exponent stays.
    best = F.reduce("runs", F.col("runs")[0], lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best)).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_substring_dedup, op3_quality_rules, op4_quality_classifier, op5_source_mixing, op6_token_id_output, op7_chat_formatting, op8_packing, op9_url_filters, op10_ngram_jaccard_join, op11_simhash_near_dedup, op12_periodic_runs, op13_filter_audit)}


def _url_sql() -> str:
    u = url_filters
    fits = [(f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))", h + p, v) for h, p, v in sorted(u.RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in fits)
    ruled = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    pure = lambda bad, labelled: f"(({bad}) + {u.WEIGHT * u.PRIOR}) / (({labelled}) + {u.WEIGHT})"
    steps = []
    for k in range(u.LEVELS):
        last = f"array_to_string(parts[{u.LEVELS}:], '/')" if k == u.LEVELS - 1 else f"coalesce(parts[{k + 1}], '')"
        whole, others = "(p.bad / p.labelled)", "(p.labelled - c.labelled)"
        steps.append(f"""
s{k} AS (SELECT *, {last} AS segment FROM t{k}),
c{k} AS (SELECT host, branch, segment, sum(labelled) AS labelled, sum(bad) AS bad FROM s{k} GROUP BY ALL),
p{k} AS (SELECT host, branch, sum(labelled) AS labelled, sum(bad) AS bad FROM c{k} GROUP BY ALL),
n{k} AS (SELECT c.host, c.branch, c.segment, CASE WHEN c.labelled = 0 OR {others} = 0 OR abs(c.bad / c.labelled - (p.bad - c.bad) / {others}) <= {u.TOLERANCE} * sqrt({whole} * (1 - {whole}) * (1 / c.labelled + 1 / {others})) THEN '*' ELSE c.segment END AS name
  FROM c{k} c JOIN p{k} p ON c.host = p.host AND c.branch = p.branch),
t{k + 1} AS (SELECT s.host, s.shape, s.parts, s.labelled, s.bad, s.branch || '/' || n.name AS branch FROM s{k} s JOIN n{k} n ON s.host = n.host AND s.branch = n.branch AND s.segment = n.segment)""")
    return f"""WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
parsed AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled, array_to_string(list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda s: s <> ''), '/') AS shape FROM parsed),
t0 AS (SELECT host, shape, string_split(shape, '/') AS parts, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS bad, '' AS branch FROM (SELECT DISTINCT host, path, shape, ruled FROM ruled) GROUP BY host, shape),{",".join(steps)},
leaf AS (SELECT host, branch, {pure("sum(bad)", "sum(labelled)")} AS purity FROM t{u.LEVELS} GROUP BY ALL)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN l.purity >= {u.BLOCK} THEN 'block' ELSE 'allow' END) AS verdict, t.branch AS template, round(l.purity, 9) AS purity
FROM ruled r JOIN t{u.LEVELS} t ON r.host = t.host AND r.shape = t.shape JOIN leaf l ON t.host = l.host AND t.branch = l.branch"""


SUBSTRING_SQL = """WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 34) AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(words, ' ')) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM again)),
holes AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, coalesce(len(h.ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN h.ps IS NULL THEN s.w ELSE [x FOR x, k IN s.w IF NOT list_contains(h.ps, k)] END, ' ')) AS kept_sha256
FROM split s LEFT JOIN holes h ON s.doc_id = h.doc_id"""

AUDIT_SQL = """WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
masks AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS fails FROM words),
known AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS before FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders)),
each AS (SELECT s.o, s.step, s.x, c.*, contains(c.fails, s.x) AS failed, length(translate(c.fails, s.before, '')) < length(c.fails) AS gone FROM steps s, cells c),
counted AS (SELECT part, o, step, x, sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN failed AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM each GROUP BY part, o, step, x)
SELECT part, o AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM counted"""

JACCARD_SQL = """WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON r.other = w.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id FROM split s LEFT JOIN sizes z ON s.doc_id = z.doc_id LEFT JOIN least l ON s.doc_id = l.doc_id"""

SQL = {"op10_ngram_jaccard_join": JACCARD_SQL, "op2_substring_dedup": SUBSTRING_SQL, "op9_url_filters": _url_sql(), "op13_filter_audit": AUDIT_SQL}
