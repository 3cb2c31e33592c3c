"""Connected components by minimum labels with pointer jumping, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is named by its smallest node.

    Each round takes the least label among neighbours and then the label of the label, so chains halve. Messages are
    partial minima; no component is gathered anywhere.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{label}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{label}-0")
    step = 0
    while True:
        step += 1
        told = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "component")
        nearer = scratch.write(told.union(labels).groupBy("node").agg(F.min("component").alias("component")), f"{label}-near")
        parent = nearer.select(F.col("node").alias("component"), F.col("component").alias("parent"))
        jumped = nearer.join(parent, "component").select("node", F.least("component", "parent").alias("component"))
        new = scratch.write(jumped, f"{label}-{step}")
        moved = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        scratch.drop(f"{label}-{step - 1}")
        labels = new
        if not moved:
            scratch.drop(f"{label}-edges", f"{label}-near")
            return labels


def named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the component of their node: its label, or itself."""
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def contracted(labels: DataFrame, edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Labels (node, component) after more edges (a, b), which are contracted to the present components first."""
    for end in ("a", "b"):
        edges = edges.join(labels.toDF(end, f"{end}_component"), end, "left").withColumn(end, F.coalesce(f"{end}_component", end)).select("a", "b")
    found = components(edges.where("a <> b").distinct(), scratch, f"{label}-found")
    renamed = labels.join(found.toDF("component", "_to"), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return scratch.write(renamed.unionByName(found.join(labels, "node", "left_anti")), label)
