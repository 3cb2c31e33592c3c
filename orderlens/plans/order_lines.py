"""The order-line view of the test tables: the representative input of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS = ["customer", "material_group"]
AS_OF = "2001-07-31"
HORIZON = 14
WEEKS = 21


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line, with its customer, material, plant and day; only columns in use are read.

    Orders meet their customers before the lines, so lines are dealt twice at most, by order and by part, and carry days
    in place of timestamps. Which of the joins broadcast is Spark's choice.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("date"))
    orders = read("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("doc_dt")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.concat(F.date_format("date", "yy"), F.lit("H"), F.when(F.month("date") <= 6, "1").otherwise("2")).alias("sheet"),
        "date",
        F.col("l_quantity").alias("net_pounds"),
        F.col("c_mktsegment").alias("customer"),
        F.col("p_type").alias("material_group"),
        F.col("p_brand").alias("material_no"),
        F.col("l_suppkey").cast("string").alias("plant"),
        F.col("l_orderkey").alias("order_no"),
        "doc_dt",
    )


def material_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with the mixed material key that partitions them into regular and intermittent series."""
    lines = order_lines(spark, sf_dir)
    return lines.withColumn("material_no", F.when(F.col("customer") == "BUILDING", F.col("material_group")).otherwise(F.col("material_no")))
