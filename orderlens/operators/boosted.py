"""One boosted-tree model over a whole panel of series: trained by Spark on all of them, and forecast day by day.

Values are taken relative to their series' mean, so that series of any size share the trees. Missing features are part of
the data: each column's missing values stand below all others, where a split can set them apart, and a flag says that a
history is too short for the longest lag.

A forecast keeps the last values of each series as an array in its row. Each day ahead computes the features from that
array, asks the model, and appends the answer; all days are projections of the same rows, without a shuffle between them.
"""

from __future__ import annotations

import math

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from . import features as f

MISSING = -1.0  # demand relative to its mean is never negative
LONGEST = max(f.LAGS)
NAMES = [*(f"lag_{k}" for k in f.LAGS), *(f"mean_{w}" for w in f.ROLLING), "std_7", "dow", "month", "quarter", "doy", "weekend", "sin_1", "cos_1", "sin_2", "cos_2", "short"]


def scaled(series: DataFrame, keys: list[str]) -> DataFrame:
    """The series relative to its mean, with that mean as `scale`; a series of zeros keeps its values."""
    means = series.groupBy(*keys).agg(F.avg("y").alias("_mean")).select(*keys, F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(1.0).alias("scale"))
    return series.join(means, keys).withColumn("y", F.col("y") / F.col("scale"))


def next_features(recent: Column, day: Column) -> dict[str, Column]:
    """`features.feature_matrix` of one day, from the values before it, oldest first."""
    size = F.size(recent)
    last = lambda w: F.slice(recent, F.greatest(size - w + 1, F.lit(1)), F.lit(w))
    count = lambda w: F.least(size, F.lit(w))
    total = lambda a: F.reduce(a, F.lit(0.0), lambda s, x: s + x)
    out = {f"lag_{k}": F.get(recent, size - k) for k in f.LAGS}
    for w in f.ROLLING:
        out[f"mean_{w}"] = F.when(count(w) >= max(2, w // 2), total(last(w)) / count(w))
    middle = total(last(7)) / count(7)
    out["std_7"] = F.when(count(7) >= 3, F.sqrt(total(F.transform(last(7), lambda x: (x - middle) * (x - middle))) / (count(7) - 1)))
    angle = 2 * math.pi * F.dayofyear(day) / f.YEAR
    out |= {"dow": F.weekday(day), "month": F.month(day), "quarter": F.quarter(day), "doy": F.dayofyear(day), "weekend": (F.weekday(day) >= 5).cast("int")}
    return out | {"sin_1": F.sin(angle), "cos_1": F.cos(angle), "sin_2": F.sin(2 * angle), "cos_2": F.cos(2 * angle)}


def _vector(rows: DataFrame) -> DataFrame:
    short = F.col(f"lag_{LONGEST}").isNull().cast("double").alias("short")
    filled = rows.select("*", short).withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(MISSING)) for n in NAMES if n != "short"})
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(filled).drop(*NAMES)


def train(series: DataFrame, keys: list[str], rounds: int = 20, depth: int = 5, seed: int = 7) -> Transformer:
    """A model of all series at once; rows with a short history take part with missing features."""
    rows = _vector(f.feature_matrix(scaled(series.select(*keys, "date", "y"), keys), keys).where("y is not null"))
    trees = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="_next", maxIter=rounds, maxDepth=depth, stepSize=0.1, maxBins=64, minInstancesPerNode=20, seed=seed)
    return trees.fit(rows.select("features", "y"))


def forecast(model: Transformer, series: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """(keys, date, yhat) of each series' next days, each forecast from the days before it; never below zero."""
    packed = scaled(series.select(*keys, "date", "y"), keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "y"))).alias("_v"), F.first("scale").alias("scale"))
    rows = packed.select(*keys, "scale", F.slice("_v.y", F.greatest(F.size("_v") - LONGEST + 1, F.lit(1)), F.lit(LONGEST)).alias("recent"), F.element_at("_v.date", -1).alias("_last"), F.array().cast("array<double>").alias("_out"))
    for step in range(1, horizon + 1):
        told = model.transform(_vector(rows.withColumns(next_features(F.col("recent"), F.date_add("_last", step)))))
        value = F.greatest(F.col("_next"), F.lit(0.0))
        keep = F.slice("recent", F.greatest(F.size("recent") - LONGEST + 2, F.lit(1)), F.lit(LONGEST - 1))
        rows = told.select(*keys, "scale", F.concat(keep, F.array(value)).alias("recent"), "_last", F.concat("_out", F.array(value)).alias("_out"))
    days = rows.select(*keys, "scale", "_last", F.posexplode("_out").alias("_step", "_y"))
    return days.select(*keys, F.expr("date_add(_last, _step + 1)").alias("date"), (F.col("_y") * F.col("scale")).alias("yhat"))


def held_out_errors(series: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """(keys, wape): of the panel's model, trained on all but each series' last `horizon` days."""
    history, held = series.where(F.col("i") <= F.col("n") - horizon), series.where(F.col("i") > F.col("n") - horizon)
    ahead = forecast(train(history, keys), history, keys, horizon)
    joined = held.join(ahead, [*keys, "date"])
    return joined.groupBy(*keys).agg((F.sum(F.abs(F.col("y") - F.col("yhat"))) / F.nullif(F.sum(F.abs("y")), F.lit(0.0)) * 100).alias("wape"))
