"""Union of sheets, data-quality counts and exact de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def union_sheets(sheets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def quality_report(rows: DataFrame) -> DataFrame:
    """Counts of loaded, bad and valid rows by sheet, in one pass; a row bad in date and number counts in both."""
    bad_date, bad_number = F.col("date").isNull(), F.col("number.value").isNull()
    return rows.groupBy("sheet").agg(
        F.count(F.lit(1)).alias("rows_loaded"),
        F.count_if(bad_date).alias("bad_dates"),
        F.count_if(bad_number).alias("bad_pounds"),
        F.count_if(~bad_date & ~bad_number).alias("rows_valid"),
        F.sum(F.when(~bad_date & ~bad_number, F.col("number.value"))).alias("pounds"),
    )


def valid_rows(rows: DataFrame) -> DataFrame:
    return rows.where("date is not null and number.value is not null").withColumn("net_pounds", F.col("number.value")).drop("number")


def drop_exact_duplicates(rows: DataFrame, ignore: tuple[str, ...] = ("sheet",), order: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """One row of each set that agrees in all columns but the ignored ones, nulls being equal; the first in order stays."""
    key = [F.col(f"`{c}`") for c in rows.columns if c not in ignore]
    first = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def count_exact_duplicates(rows: DataFrame, ignore: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """How many rows `drop_exact_duplicates` removes, from counts by key."""
    key = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(rows.columns) if c not in ignore]
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))
