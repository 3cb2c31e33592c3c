"""Choice of a model from backtest measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

NAIVE = "Seasonal Naive"
GAIN = 2.0


def _marked(measures: DataFrame) -> DataFrame:
    return measures if "skipped" in measures.columns else measures.withColumn("skipped", F.lit(False))


def leaderboard(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Models by WAPE, then MAE, then bias; skipped ones last."""
    best_first = Window.partitionBy(*keys).orderBy("skipped", F.col("wape").asc_nulls_last(), F.col("mae").asc_nulls_last(), F.col("abs_pct_bias").asc_nulls_last(), "model")
    ranked = _marked(measures).withColumn("rank", F.row_number().over(best_first).cast("bigint"))
    return ranked if "skipped" in measures.columns else ranked.drop("skipped")


def recommend(measures: DataFrame, keys: list[str]) -> DataFrame:
    """The best model by WAPE, MAE and bias, if it beats the seasonal naive by `GAIN` points; else the seasonal naive.

    Skipped models take no part; a segment without any other gets "None".
    """
    marked = _marked(measures)
    board = leaderboard(marked.where("not skipped"), keys)
    naive = board.where(F.col("model") == NAIVE).select(*keys, F.col("wape").alias("naive_wape"))
    best = board.where("rank = 1").select(*keys, F.col("model").alias("best_model"), F.col("wape").alias("best_wape"))
    joined = marked.select(*keys).distinct().join(best, keys, "left").join(naive, keys, "left")
    gain, none = F.col("naive_wape") - F.col("best_wape"), F.col("best_model").isNull()
    takes = (F.col("best_model") == NAIVE) | F.col("naive_wape").isNull() | (gain >= GAIN)
    reason = F.when(none, "no model has usable backtest results").when(F.col("best_model") == NAIVE, "seasonal naive is best").when(F.col("naive_wape").isNull(), "seasonal naive was not evaluated").when(gain >= GAIN, "gain is meaningful").otherwise("gain is too small")
    return joined.select(*keys, F.when(none, "None").when(takes, F.col("best_model")).otherwise(NAIVE).alias("recommended"), "best_model", "best_wape", "naive_wape", reason.alias("reason"))


def best_by_wape(measures: DataFrame, keys: list[str]) -> DataFrame:
    """The batch rule: least WAPE alone of the models that are not skipped, ties by name."""
    least = Window.partitionBy(*keys).orderBy(F.col("wape").asc_nulls_last(), "model")
    return _marked(measures).where("not skipped").withColumn("_r", F.row_number().over(least)).where("_r = 1").select(*keys, F.col("model").alias("best_model_by_wape"), "wape")
