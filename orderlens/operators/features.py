"""Window features of a daily series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

LAGS = (1, 2, 3, 7, 14, 21, 28)
ROLLING = (7, 14, 28)
YEAR = 365.25


def _guarded(value: Column, count: Column, least: int) -> Column:
    return F.when(count >= least, value)


def feature_matrix(series: DataFrame, keys: list[str], events: list[str] | None = None) -> DataFrame:
    """Lags, shifted rolling means and deviation, calendar and yearly Fourier terms, and an event flag if dates are given."""
    by = Window.partitionBy(*keys).orderBy("date")
    y, day = F.col("y"), F.col("date")
    columns = {f"lag_{k}": F.lag("y", k).over(by) for k in LAGS}
    for w in ROLLING:
        past = by.rowsBetween(-w, -1)
        columns[f"mean_{w}"] = _guarded(F.avg(y).over(past), F.count(y).over(past), max(2, w // 2))
    past = by.rowsBetween(-7, -1)
    columns["std_7"] = _guarded(F.stddev_samp(y).over(past), F.count(y).over(past), 3)
    angle = 2 * math.pi * F.dayofyear(day) / YEAR
    columns |= {"dow": F.weekday(day).cast("bigint"), "month": F.month(day).cast("bigint"), "quarter": F.quarter(day).cast("bigint"), "doy": F.dayofyear(day).cast("bigint"), "weekend": (F.weekday(day) >= 5).cast("bigint"), "sin_1": F.sin(angle), "cos_1": F.cos(angle), "sin_2": F.sin(2 * angle), "cos_2": F.cos(2 * angle)}
    if events is not None:
        columns["event"] = day.isin([F.lit(e).cast("date") for e in events]).cast("bigint")
    return series.withColumns(columns)


def rolling_means(series: DataFrame, keys: list[str]) -> DataFrame:
    """Trailing means that include the current day."""
    by = Window.partitionBy(*keys).orderBy("date")
    return series.withColumns({f"mean_{w}": _guarded(F.avg("y").over(by.rowsBetween(1 - w, 0)), F.count("y").over(by.rowsBetween(1 - w, 0)), max(2, w // 2)) for w in ROLLING})


def centred_mean(value: Column, keys: list[str], window: int = 91, least: int = 28) -> Column:
    """Mean over a centred window that is cut at the ends of the series."""
    around = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(window // 2), window // 2)
    return _guarded(F.avg(value).over(around), F.count(value).over(around), least)


def weekday_profile(series: DataFrame, keys: list[str]) -> DataFrame:
    return series.groupBy(*keys, F.weekday("date").cast("bigint").alias("dow")).agg(F.avg("y").alias("mean"))


def last_rows(series: DataFrame, keys: list[str], n: int) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return series.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n).drop("_back")
