"""Demand classes and weekday statistics of zero-filled series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .features import last_rows

DORMANT, NEW, REGULAR, INTERMITTENT = "Dormant", "New", "Regular", "Intermittent"
MODELS = {DORMANT: None, NEW: "Seasonal Naive", REGULAR: "AutoETS", INTERMITTENT: "AutoARIMA"}  # fixed values: the model of each class
MIN_FIT, DORMANT_DAYS, NEW_DAYS, DENSITY_DAYS, DENSITY, RECENT_DAYS, STATS_DAYS = 14, 60, 90, 90, 0.4, 28, 182
CAP = 0.95


def profiles(series: DataFrame, keys: list[str], as_of: str, dormant: int = DORMANT_DAYS, new: int = NEW_DAYS, dense: float = DENSITY) -> DataFrame:
    """One row a key: span, recency, recent mean, extremes, density and class of its history."""
    day = F.lit(as_of).cast("date")
    history = series.where(~F.col("is_backlog"))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("date").desc()))
    marked = history.withColumn("_back", back)
    recent, window = F.col("_back") <= RECENT_DAYS, F.col("_back") <= DENSITY_DAYS
    found = marked.groupBy(*keys).agg(
        (F.datediff(day, F.min("date")) + 1).cast("bigint").alias("span_days"),
        F.datediff(day, F.max(F.when(F.col("y") > 0, F.col("date")))).cast("bigint").alias("_since"),
        F.avg(F.when(recent, F.col("y"))).alias("recent_avg"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.avg(F.when(window, (F.col("y") > 0).cast("double"))).alias("density"),
    )
    found = found.withColumn("days_since", F.coalesce("_since", "span_days")).drop("_since")
    kind = F.when((F.col("span_days") < MIN_FIT) | (F.col("days_since") > dormant), DORMANT).when(F.col("span_days") < new, NEW).when(F.col("density") >= dense, REGULAR).otherwise(INTERMITTENT)
    return found.withColumn("demand_class", kind)


def weekday_stats(series: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation and 95th percentile of each weekday (0 is Sunday) over the last half year of history."""
    tail = last_rows(series.where(~F.col("is_backlog")), keys, STATS_DAYS)
    return tail.groupBy(*keys, (F.dayofweek("date") - 1).cast("bigint").alias("dow")).agg(F.avg("y").alias("mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("std"), F.percentile("y", F.lit(CAP)).alias("cap"))


def class_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("demand_class").agg(F.count(F.lit(1)).alias("n"))
