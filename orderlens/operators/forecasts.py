"""Forecasts and backtests that SQL windows express: seasonal naive and two averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SEASON = 7
WINDOWS = 8
MIN_TRAIN = 60
Z80 = 1.28


def seasonal_naive(series: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """The last week repeated, with an 80% interval from seasonal differences; series under a week give nothing.

    `series` is a modelling series with position i of n.
    """
    by = Window.partitionBy(*keys).orderBy("date")
    marked = series.withColumns({"_diff": F.col("y") - F.lag("y", SEASON).over(by)}).where(F.col("n") >= SEASON)
    spread = marked.groupBy(*keys).agg(F.coalesce(F.stddev_pop("_diff"), F.lit(0.0)).alias("_spread"), F.max("date").alias("_last"))
    week = marked.where(F.col("i") > F.col("n") - SEASON).select(*keys, (F.col("i") - F.col("n") + SEASON - 1).alias("_place"), "y")
    steps = spread.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn("_place", ((F.col("step") - 1) % SEASON).cast("bigint"))
    out = steps.join(week, [*keys, "_place"])
    return out.select(*keys, F.date_add("_last", F.col("step")).alias("date"), F.col("step").cast("bigint").alias("step"), F.col("y").alias("yhat"), F.greatest(F.lit(0.0), F.col("y") - Z80 * F.col("_spread")).alias("lower"), (F.col("y") + Z80 * F.col("_spread")).alias("upper"))


def window_count(n: Column, horizon: int) -> Column:
    """How many non-overlapping test windows a series of n days has."""
    possible = F.floor((n - MIN_TRAIN) / horizon)
    return F.when(n >= MIN_TRAIN + horizon, F.greatest(F.lit(1), F.least(F.lit(WINDOWS), possible))).otherwise(0).cast("bigint")


def origins(series: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Test windows of each key, oldest first: window, and the number of training days."""
    sizes = series.groupBy(*keys).agg(F.max("n").alias("n")).withColumn("windows", window_count(F.col("n"), horizon)).where("windows > 0")
    each = sizes.select(*keys, "n", "windows", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("windows"))).alias("window"))
    return each.withColumn("train_days", F.col("n") - (F.col("windows") - F.col("window") + 1) * horizon)


def backtest(series: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """(keys, model, window, date, y, yhat) of three models over all rolling origins.

    The tests of a key never overlap, so a day has one window; predictions look up earlier days of the same series
    through one array of its values, built once for a key.
    """
    values = series.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "date", "y"))), lambda s: s).alias("_v"), F.max("n").alias("n"))
    tests = values.withColumn("windows", window_count(F.col("n"), horizon)).where("windows > 0").select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("windows") * horizon)).alias("_t"))
    window, step = F.floor((F.col("_t") - 1) / horizon) + 1, (F.col("_t") - 1) % horizon
    origin = F.col("n") - (F.col("windows") - window + 1) * horizon
    at = lambda i: F.element_at("_v", i.cast("int"))["y"]
    same = origin - SEASON + (step % SEASON) + 1
    rows = tests.select(
        *keys, window.cast("bigint").alias("window"), F.element_at("_v", (origin + step + 1).cast("int")).alias("_day"),
        at(same).alias("Seasonal Naive"),
        ((at(same) + at(same - 7) + at(same - 14) + at(same - 21)) / 4).alias("Weekday Mean"),
        (F.aggregate(F.slice("_v", (origin - 27).cast("int"), 28), F.lit(0.0), lambda s, x: s + x["y"]) / 28).alias("Trailing Mean"),
    )
    return rows.select(*keys, "window", F.col("_day.date").alias("date"), F.col("_day.y").alias("y"), F.expr("stack(3, 'Seasonal Naive', `Seasonal Naive`, 'Weekday Mean', `Weekday Mean`, 'Trailing Mean', `Trailing Mean`) as (model, yhat)"))


def mase_scale(series: DataFrame, keys: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("date")
    return series.withColumn("_d", F.abs(F.col("y") - F.lag("y", SEASON).over(by))).groupBy(*keys).agg(F.avg("_d").alias("scale"))


def metrics(tests: DataFrame, scale: DataFrame, keys: list[str]) -> DataFrame:
    """The eight error measures of each key and model over all its test days."""
    y, p = F.col("y"), F.col("yhat")
    size = F.abs(y) + F.abs(p)
    joined = tests.join(scale, keys)
    out = joined.groupBy(*keys, "model").agg(
        (100 * F.sum(F.abs(y - p)) / F.nullif(F.sum(F.abs(y)), F.lit(0.0))).alias("wape"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (100 * F.avg(F.when(size == 0, 0.0).otherwise(2 * F.abs(y - p) / size))).alias("smape"),
        (F.avg(F.abs(y - p)) / F.nullif(F.first("scale"), F.lit(0.0))).alias("mase"),
        F.avg(p - y).alias("bias"),
        (100 * F.abs(F.sum(p) - F.sum(y)) / F.nullif(F.abs(F.sum(y)), F.lit(0.0))).alias("abs_pct_bias"),
        F.countDistinct("window").alias("n_windows"),
    )
    return out.withColumn("accuracy", F.when(F.col("wape").isNotNull(), F.greatest(F.lit(0.0), 100 - F.col("wape"))))


def fraction_errors(y: Column, p: Column) -> tuple[Column, Column]:
    """WAPE and bias as fractions of total demand."""
    total = F.nullif(F.sum(F.abs(y)), F.lit(0.0))
    return F.sum(F.abs(p - y)) / total, F.sum(p - y) / total
