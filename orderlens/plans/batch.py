"""The batch: backtest and forecast every segment of an order workbook, into the result store.

    python -m orderlens.plans.batch --workbook orders.xlsx --store results --excel-out overall.xlsx --as-of 2026-06-30

The store has three tables of runs: segment_summary, segment_metrics and segment_forecasts, committed together. Segments
that a run has stored already are skipped.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import forecasts, models, selection, series
from ..sources import loading, store, xlsx
from ..workspace import Workspace

KEYS = ["customer", "material_group"]
OVERALL = "__OVERALL__"
COLUMNS = {"Seasonal Naive": "seasonal_naive", "AutoARIMA": "autoarima", "AutoETS": "autoets", "HistGradientBoosting": "hgb"}


def daily_of(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Daily sums of the wanted segments, the overall one among them if it is wanted."""
    total = series.daily_sum(lines, []).select(*(F.lit(OVERALL).alias(k) for k in KEYS), "date", "y")
    return series.daily_sum(lines, KEYS).unionByName(total).join(segments.select(*KEYS), KEYS, "left_semi")


def wide_forecasts(found: DataFrame, backlog: DataFrame) -> DataFrame:
    """(keys, forecast_date, a column for each model, average, known_backlog): models floored by backlog, then averaged."""
    floored = found.where("status = 'ok'").join(backlog, [*KEYS, "date"], "left").fillna(0.0, ["known_backlog"]).withColumn("v", F.greatest("yhat", "known_backlog"))
    floored = floored.withColumn("model", F.replace("model", F.lit(" (thorough)"), F.lit("")))
    wide = floored.groupBy(*KEYS, F.col("date").alias("forecast_date")).pivot("model", list(COLUMNS)).agg(F.first("v"))
    average = floored.groupBy(*KEYS, F.col("date").alias("forecast_date")).agg(F.avg("v").alias("average"), F.first("known_backlog").alias("known_backlog"))
    return wide.join(average, [*KEYS, "forecast_date"]).select(*KEYS, "forecast_date", *(F.col(f"`{m}`").alias(c) for m, c in COLUMNS.items()), "average", "known_backlog")


def run(lines: DataFrame, as_of: dt.date, horizon: int, segments: DataFrame, names: list[str] | None = None, work: Workspace | None = None) -> dict[str, DataFrame]:
    """The three result tables of the segments, without their run date.

    A segment without history is "skipped", one without any forecast "error"; neither stops the others. Forecasts need
    `models.LEAST_FINAL` days of history. The tables read those of `work`.
    """
    names, day = names or models.BATCH, as_of.isoformat()
    work = work or Workspace(lines.sparkSession, "batch")
    daily = work.keep(daily_of(lines, segments), "daily")
    history = work.keep(series.modelled(daily, KEYS, day), "history")
    tests = work.keep(models.backtest_panel(history, KEYS, horizon, names), "tests")
    good = tests.where("error is null")
    measures = forecasts.metrics(good, forecasts.mase_scale(history, KEYS), KEYS)
    metrics = work.keep(models.roll_up(tests, measures, KEYS, names, history.select(*KEYS).distinct()), "metrics")
    found = work.keep(models.fit_panel(history, KEYS, horizon, names, least=models.LEAST_FINAL), "found")
    backlog = daily.where(F.col("date") > F.lit(as_of)).select(*KEYS, "date", F.col("y").alias("known_backlog"))
    wide = wide_forecasts(found, backlog)
    span = history.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("historical_days"))
    booked = backlog.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("backlog_days"))
    ok = found.groupBy(*KEYS).agg(F.count_if(F.col("status") == "ok").alias("_ok"), F.min(F.when(F.col("status") != "ok", F.col("status"))).alias("_why"))
    best = selection.best_by_wape(metrics, KEYS).select(*KEYS, "best_model_by_wape")
    summary = segments.select(*KEYS).join(span, KEYS, "left").join(booked, KEYS, "left").join(best, KEYS, "left").join(ok, KEYS, "left").fillna(0, ["historical_days", "backlog_days", "_ok"])
    status = F.when(F.col("historical_days") == 0, "skipped").when(F.col("_ok") == 0, "error").otherwise("ok")
    message = F.when(F.col("historical_days") == 0, "no historical data").when(F.col("_ok") == 0, F.col("_why"))
    return {
        "segment_summary": summary.select(*KEYS, "historical_days", "backlog_days", "best_model_by_wape", status.alias("status"), message.alias("error_message")),
        "segment_metrics": metrics.select(*KEYS, "model", "wape", "mae", "rmse", "smape", "mase", "bias", "abs_pct_bias", F.col("accuracy").alias("accuracy_score"), "n_success_windows", "n_failed_windows", "skipped", "skip_reason"),
        "segment_forecasts": wide,
    }


def run_batch(lines: DataFrame, folder: str, as_of: dt.date, run_date: str, horizon: int = 21, limit: int | None = None, overwrite: bool = False, names: list[str] | None = None) -> dict[str, int]:
    """Run all segments that the run date has not stored yet; returns the number of segments by status."""
    spark = lines.sparkSession
    wanted = series.segments(lines, KEYS, limit).select(*KEYS)
    stored = store.read_table(spark, folder, "segment_summary")
    if stored is not None and not overwrite:
        wanted = store.not_done(wanted, stored, run_date)
    if wanted.isEmpty():
        return {}
    work = Workspace(spark, "batch")
    wanted = work.keep(wanted, "wanted")
    store.Store(spark, folder).commit(run(lines, as_of, horizon, wanted, names, work), run_date, KEYS)
    done = store.read_table(spark, folder, "segment_summary").where(F.col("run_date") == run_date).join(wanted, KEYS, "left_semi")
    counts = {r["status"]: r["n"] for r in done.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    work.close()
    return counts


def export_overall(spark: SparkSession, folder: str, run_date: str, path: str) -> bool:
    """The overall segment's forecast and accuracy as a workbook of two sheets; False if the run has none."""
    mine = (F.col("run_date") == run_date) & (F.col("customer") == OVERALL)
    ahead = store.read_table(spark, folder, "segment_forecasts").where(mine).drop("run_date", *KEYS).orderBy("forecast_date")
    if ahead.isEmpty():
        return False
    accuracy = store.read_table(spark, folder, "segment_metrics").where(mine).select("model", "wape", "mae", "accuracy_score", "skipped", "skip_reason").orderBy("model")
    values = {c: xlsx.TENTH for c, t in [*ahead.dtypes, *accuracy.dtypes] if t == "double"}
    xlsx.write_frames(path, {"Overall Forecast": ahead, "Backtest Accuracy": accuracy}, looks={n: xlsx.Look(values) for n in ("Overall Forecast", "Backtest Accuracy")})
    return True


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description="Backtest and forecast every segment of an order workbook.")
    p.add_argument("--workbook", required=True)
    p.add_argument("--store", default="results")
    p.add_argument("--excel-out", default="overall_forecast.xlsx")
    p.add_argument("--horizon", type=int, default=21)
    p.add_argument("--thorough-arima", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--as-of", type=dt.date.fromisoformat)
    p.add_argument("--run-date")
    a = p.parse_args(arguments)
    if spark is None:
        from ..session import session

        spark = session()
    lines = loading.load_workbook(spark, a.workbook).rows
    run_date = a.run_date or dt.date.today().isoformat()
    names = [f"{m} (thorough)" if a.thorough_arima and m == "AutoARIMA" else m for m in models.BATCH]
    print(run_batch(lines, a.store, a.as_of or dt.date.today(), run_date, a.horizon, a.limit, a.overwrite, names))
    export_overall(spark, a.store, run_date, a.excel_out)


if __name__ == "__main__":
    main()
