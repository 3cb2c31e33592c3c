"""Output tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from .series import week_end


def actual_vs_forecast(actual: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    rows = lambda df, c, t: df.select(*keys, "date", F.col(c).alias("value"), F.lit(t).alias("type"))
    return rows(actual, "y", "actual").unionByName(rows(forecast, "yhat", "forecast"))


def final_table(adjusted: DataFrame, keys: list[str], model: str | None = None) -> DataFrame:
    """The forecast table at two decimals; `base_forecast` is the model's own, `combined_projection` floored by backlog.

    `model` names the only model; without it, rows of several models carry a column of that name.
    """
    two = lambda c: F.round(c, 2)
    named = F.col("model") if model is None else F.lit(model).alias("model")
    return adjusted.select(*keys, F.col("date").alias("forecast_date"), named, two("yhat").alias("base_forecast"), two("backlog").alias("known_backlog"), two("combined").alias("combined_projection"), two(F.col("share") * 100).alias("uplift_pct"), two("final_forecast").alias("final_forecast"), (F.col("share") > 0).alias("is_high_production_date"))


def stamped(table: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """Adds `generated_at`, the time of the run to the second as ISO text; `at` fixes it."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if at is None else F.lit(at.isoformat(timespec="seconds"))
    return table.withColumn("generated_at", now)


def wide_actual_forecast(history: DataFrame, forecasts: DataFrame, keys: list[str], models: list[str], lookback: int | None = None) -> DataFrame:
    """One row a key and day: forecasts of the models and their average, then actual values, each newest first.

    `place` is a row's place within its key. Models without a forecast for a day are left out of its average. `lookback`
    keeps that many of the newest actual days.
    """
    wide = forecasts.groupBy(*keys, "date").pivot("model", models).agg(F.first("final_forecast"))
    average = F.expr("aggregate(array_compact(array(" + ", ".join(f"`{m}`" for m in models) + ")), cast(0 as double), (s, x) -> s + x)") / F.nullif(F.size(F.array_compact(F.array(*(F.col(f"`{m}`") for m in models)))), F.lit(0))
    ahead = wide.select(*keys, "date", F.lit("Forecast").alias("type"), F.lit(None).cast("double").alias("Actual"), *(F.col(f"`{m}`") for m in models), average.alias("Average"))
    past = history.where("y is not null").select(*keys, "date", F.lit("Actual").alias("type"), F.col("y").alias("Actual"))
    if lookback is not None:
        newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
        past = past.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= lookback).drop("_back")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("type").desc(), F.col("date").desc())).cast("bigint")
    return ahead.unionByName(past, allowMissingColumns=True).withColumn("place", place)


def wide_models(forecasts: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Models as columns, with their average."""
    wide = forecasts.groupBy(*keys, "date").pivot("model", models).agg(F.first("yhat"))
    return wide.withColumn("average", sum((F.col(f"`{m}`") for m in models[1:]), F.col(f"`{models[0]}`")) / len(models))


def weekly(series: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of weeks that end on Saturday."""
    return series.groupBy(*keys, week_end(F.col("date")).alias("week_end")).agg(F.sum("y").alias("y"))


def weekly_overall(company: DataFrame, detail: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """The company's weeks; the detail total, and what follows from it, only where all seven days are there.

    `context` (date, slot, factor) names the holiday slots of the company's days.
    """
    week = week_end(F.col("date")).alias("week_end")
    total = company.groupBy(week).agg(F.sum("backlog").alias("backlog"), F.sum(F.greatest(F.col("model") - F.col("backlog"), F.lit(0.0))).alias("additional"), F.sum("initial").alias("total"), F.countDistinct("date").alias("_days"))
    excess, missing = F.greatest(F.col("backlog") - F.col("model_final"), F.lit(0.0)), F.col("model_final")
    own = detail.groupBy(week).agg(F.sum("final").alias("_detail"), F.sum(excess).alias("_excess"), F.sum(missing).alias("_after"), F.countDistinct("date").alias("days"))
    target = company.groupBy(week).agg(F.sum("model").alias("_target"))
    joined = total.join(own, "week_end", "left").join(target, "week_end")
    whole = (F.col("days") == 7) & (F.col("_days") == 7)
    out = joined.select("week_end", "backlog", "additional", "total", *(F.when(whole, x).alias(n) for n, x in (("detail", F.col("_detail")), ("difference", F.col("_detail") - F.col("total")), ("excess", F.col("_excess")), ("unresolved", F.col("_after") - F.col("_target")))))
    if context is None:
        return out
    named = context.where("slot is not null").groupBy(week_end(F.col("date")).alias("week_end"), "slot").agg(F.min("date").alias("_day"), F.first("factor").alias("_factor"))
    label = F.concat("slot", F.lit(" (x"), F.format_number(F.round("_factor", 9), 2), F.lit(")"))
    texts = named.groupBy("week_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_day", "slot", label.alias("t")))), lambda s: s["t"]), "; ").alias("holiday_context"))
    return out.join(texts, "week_end", "left").fillna("", ["holiday_context"])


def holiday_effects(company: DataFrame, materials: DataFrame, slots: list[str]) -> DataFrame:
    """Slots as columns: the company's factors, its evidence, and each material's factors; a slot without evidence has its parent's factor.

    `company` is (slot, factor, n_obs), `materials` (material_no, slot, factor).
    """
    known = company.select("slot", F.col("factor").alias("_company"), "n_obs")
    each = materials.select("material_no").distinct().crossJoin(F.broadcast(company.sparkSession.createDataFrame([(s,) for s in slots], "slot string")))  # slots are those of the calendar
    own = each.join(materials.select("material_no", "slot", "factor"), ["material_no", "slot"], "left").join(F.broadcast(known), "slot", "left")
    rows = (
        known.select(F.lit("company factor").alias("level"), F.lit("").alias("material_no"), "slot", F.round("_company", 3).alias("v"))
        .unionByName(known.select(F.lit("company evidence").alias("level"), F.lit("").alias("material_no"), "slot", F.round("n_obs", 2).alias("v")))
        .unionByName(own.select(F.lit("material factor").alias("level"), "material_no", "slot", F.round(F.coalesce("factor", "_company", F.lit(1.0)), 3).alias("v")))
    )
    wide = rows.groupBy("level", "material_no").pivot("slot", slots).agg(F.first("v"))
    missing = {s: F.coalesce(F.col(f"`{s}`"), F.when(F.col("level") == "company evidence", 0.0).otherwise(1.0)) for s in slots}
    return wide.select("level", "material_no", *(x.alias(s) for s, x in missing.items()))


def actual_matrix(actual: DataFrame, keys: DataFrame, names: list[str], days: DataFrame) -> DataFrame:
    """(keys, date, y) for every key and day of a window; what has no order is 0."""
    grid = keys.select(*names).distinct().crossJoin(F.broadcast(days.select("date").distinct()))  # the window's days
    return grid.join(actual.select(*names, "date", "y"), [*names, "date"], "left").fillna(0.0, ["y"])


def variant_pivot(values: DataFrame, variants: list[str]) -> DataFrame:
    """(metric, variant, value) with a column for each variant."""
    return values.groupBy("metric").pivot("variant", variants).agg(F.first("value"))


def wide_forecast(final: DataFrame, keys: list[str], days: list[str]) -> DataFrame:
    """One row a key, one column a day of the horizon, at one decimal; a day without a row is null."""
    return final.withColumn("_day", F.date_format("date", "yyyy-MM-dd")).groupBy(*keys).pivot("_day", days).agg(F.round(F.round(F.first("final"), 6), 1))
