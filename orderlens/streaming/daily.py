"""An extension: daily totals of an event stream, kept fresh by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_totals(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Count and value by day and type; a day closes once events are `late` past its end."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.to_date("window.start").alias("date"), "event_type", "n", "value")
