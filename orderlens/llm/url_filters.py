"""URL filter by a path-template tree, in DataFrame functions only.

Explicit rules decide first. For all other urls each host has a tree of path templates: runs of digits in a segment
become wildcards, and from the root down, children of a node whose labelled share of bad urls does not differ from that
of their siblings by a two-sample test are merged into one wildcard branch, while others keep branches of their own. A
child without labels, or whose siblings have none, gives no reason to set it apart and is merged. A template is blocked
where its smoothed labelled purity, the share of bad among its labelled urls, reaches `BLOCK`.

The urls that rules decide are the labels; equal urls count once, so repeated rows change no verdict. The tree is built
from counts by distinct template, so a hot host costs partial sums, and the join back to the urls is one that adaptive
execution can split. The rule list is configuration and compiles into the plan.

Defined cases: a null url, or one without "://", has an empty host and path; such urls form one host; a template
without labels is allowed; an empty table gives an empty result; rows may repeat or share an id; other columns never
take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

# Host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

LEVELS = 3
WEIGHT = 2.0
PRIOR = 0.1
TOLERANCE = 2.0
BLOCK = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def template(path: Column) -> Column:
    """The path's segments with digits as wildcards; segments beyond the tree's levels stay one tail."""
    return F.array_join(F.filter(F.split(F.regexp_replace(path, "[0-9]+", "*"), "/"), lambda s: s != ""), "/")


def _purity(bad: Column, labelled: Column) -> Column:
    return (bad + WEIGHT * PRIOR) / (labelled + WEIGHT)


def build_tree(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shape, template, purity) from (host, shape, labelled, bad), one row for each host and shape."""
    pieces = F.split(F.col("shape"), "/", LEVELS)
    tree = counts.withColumn("branch", F.lit(""))
    for level in range(LEVELS):
        tree = tree.withColumn("segment", F.coalesce(F.get(pieces, F.lit(level)), F.lit("")))
        child = tree.groupBy("host", "branch", "segment").agg(F.sum("labelled").alias("c_labelled"), F.sum("bad").alias("c_bad"))
        parent = child.groupBy("host", "branch").agg(F.sum("c_labelled").alias("p_labelled"), F.sum("c_bad").alias("p_bad"))
        known, others, whole = F.col("c_labelled"), F.col("p_labelled") - F.col("c_labelled"), F.col("p_bad") / F.col("p_labelled")
        apart = F.abs(F.col("c_bad") / known - (F.col("p_bad") - F.col("c_bad")) / others)
        alike = F.when((known == 0) | (others == 0), True).otherwise(apart <= TOLERANCE * F.sqrt(whole * (1 - whole) * (1 / known + 1 / others)))
        named = child.join(parent, ["host", "branch"]).select("host", "branch", "segment", F.when(alike, "*").otherwise(F.col("segment")).alias("name"))
        tree = tree.join(named, ["host", "branch", "segment"]).select("host", "shape", "labelled", "bad", F.concat("branch", F.lit("/"), "name").alias("branch"))
        tree = scratch.write(tree, f"level-{level}")
    leaf = tree.groupBy("host", "branch").agg(_purity(F.sum("bad"), F.sum("labelled")).alias("purity"))
    return tree.join(leaf, ["host", "branch"]).select("host", "shape", F.col("branch").alias("template"), "purity")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every page."""
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "ruled": verdict, "shape": template(F.col("path"))})
    once = ruled.select("host", "path", "shape", "ruled").distinct()
    counts = once.groupBy("host", "shape").agg(F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("bad"))
    scratch = Scratch(pages.sparkSession, "url_filters")
    tree = scratch.write(build_tree(scratch.write(counts, "counts"), scratch), "tree")
    out = ruled.join(tree, ["host", "shape"])
    method = F.when(F.col("purity") >= BLOCK, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", F.round("purity", 9).alias("purity"))
