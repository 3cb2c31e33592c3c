"""The reconciled forecast: company, materials and combinations from order lines to workbook.

    python -m orderlens.plans.reconciled --workbook orders.xlsx --out forecast.xlsx --as-of 2026-06-30

Every series, profile and forecast that several steps read is written once to a workspace, so each plan stays small.
"""

from __future__ import annotations

import argparse
import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import classify, forecasts, holidays, models, reconcile, reports, series
from ..sources import loading, xlsx
from ..workspace import Workspace

ALL = ["all"]
VARIANTS = ["With holiday effects", "Without holiday effects"]


@dataclass
class Settings:
    """What a run may change; the defaults are those of the demand classes, holidays and reconciliation."""

    use_holidays: bool = True
    include_backlog: bool = True
    weekday_shaping: bool = True
    thorough: bool = False
    holiday_k: float = holidays.K_COMBO
    max_cut: float = reconcile.MAX_CUT
    dormant_days: int = classify.DORMANT_DAYS
    new_days: int = classify.NEW_DAYS
    density: float = classify.DENSITY
    limit: int | None = None
    naive_only: bool = False  # every class by the seasonal naive, which SQL can check


@dataclass
class Run:
    keys: list[str]
    as_of: dt.date
    days: list[dt.date]
    company: DataFrame  # date, base, hf, model, backlog, additional, initial
    detail: DataFrame  # keys, date, base, hf, m, backlog, has_model, demand_class
    reconciled: DataFrame
    classes: DataFrame
    fitted: DataFrame  # keys, model
    calendar: DataFrame
    profiles: dict[str, DataFrame] = field(default_factory=dict)
    work: Workspace | None = None  # the tables that all of these read


def _window(spark: SparkSession, days: list[dt.date]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], "date date")


def _forecast(history: DataFrame, classes: DataFrame, keys: list[str], steps: int, settings: Settings, thorough: bool) -> DataFrame:
    """(keys, date, base, model) of the classes' models; failed fits have no rows."""
    if settings.naive_only:
        numbered = series.numbered(history, keys)
        some = numbered.join(classes.where(F.col("demand_class") != classify.DORMANT).select(*keys), keys)
        return forecasts.seasonal_naive(some, keys, steps).select(*keys, "date", F.greatest("yhat", F.lit(0.0)).alias("base"), F.lit("Seasonal Naive").alias("model"))
    found = models.fit_by_class(history, classes, keys, steps, thorough)
    return found.where("status = 'ok'").select(*keys, "date", F.col("yhat").alias("base"), "model")


@dataclass
class History:
    """What every variant of a run reads: it depends on the lines, the as-of day and the classes' bounds only."""

    work: Workspace
    keys: list[str]
    daily: DataFrame  # keys, date, y
    total: DataFrame  # date, y, all
    calendar: DataFrame
    rows: DataFrame  # zero-filled series of the keys
    classes: DataFrame
    stats: DataFrame  # keys, dow, mean, std, cap
    company_rows: DataFrame
    company_class: DataFrame
    material_rows: DataFrame


def prepare(lines: DataFrame, as_of: dt.date, last: dt.date, keys: list[str] | None = None, settings: Settings | None = None, work: Workspace | None = None) -> History:
    """Series, classes and calendar of a run whose last day ahead is `last`, each written once."""
    spark, settings = lines.sparkSession, settings or Settings()
    work = work or Workspace(spark, "reconciled")
    keys = keys or [*(["plant"] if "plant" in lines.columns else []), "customer", "material_no"]
    day, bounds = as_of.isoformat(), (settings.dormant_days, settings.new_days, settings.density)
    # The lines are read once: the series of every level are sums of these cells, null keys among them.
    cells = work.keep(lines.groupBy(*dict.fromkeys([*keys, "material_no"]), "date").agg(F.sum("net_pounds").alias("net_pounds")), "cells")
    daily = work.keep(series.daily_sum(cells, keys), "daily")
    total = work.keep(series.daily_sum(cells, []).withColumn("all", F.lit("all")), "total")
    first = total.agg(F.min("date")).first()[0]
    if first is None or first > as_of:
        raise ValueError("no order on or before the as-of day")
    calendar = work.keep(holidays.calendar(spark, first - dt.timedelta(holidays.PADDING), last + dt.timedelta(holidays.PADDING)), "calendar")
    every = series.zero_filled(daily, keys, day)
    if settings.limit is not None:
        every = every.join(series.segments(daily, keys, settings.limit).select(*keys), keys, "left_semi")
    rows = work.keep(every, "rows")
    company_rows = work.keep(series.zero_filled(total, ALL, day), "company_rows")
    return History(
        work, keys, daily, total, calendar, rows,
        work.keep(classify.profiles(rows, keys, day, *bounds), "classes"),
        work.keep(classify.weekday_stats(rows, keys), "stats"),
        company_rows,
        work.keep(classify.profiles(company_rows, ALL, day, *bounds), "company_class"),
        series.zero_filled(series.daily_sum(cells, ["material_no"]), ["material_no"], day),
    )


def build(lines: DataFrame, as_of: dt.date, days: list[dt.date], overall_days: list[dt.date] | None = None, keys: list[str] | None = None, settings: Settings | None = None, by: str = "week", history: History | None = None) -> Run:
    """Forecast the company and every key over the days, and reconcile the keys with the company.

    `lines` are (date, net_pounds, customer, material_no, ...); lines after the as-of day are booked backlog. The
    company's series holds every line, also those with a null key. `history` may be shared by runs that differ in their
    variant only; it is closed with its own workspace then.
    """
    spark, settings = lines.sparkSession, settings or Settings()
    overall_days = overall_days or days
    if min(days[0], overall_days[0]) <= as_of:
        raise ValueError("forecast days must be after the as-of day")
    last = max(days[-1], overall_days[-1])
    work = history.work.part("run") if history else Workspace(spark, "reconciled")
    past = history or prepare(lines, as_of, last, keys, settings, work)
    keys, steps = past.keys, (last - as_of).days
    window, overall_window = _window(spark, days), _window(spark, overall_days)
    daily, total, calendar, rows, classes, company_rows, company_class, stats = past.daily, past.total, past.calendar, past.rows, past.classes, past.company_rows, past.company_class, past.stats

    profiles: dict[str, DataFrame] = {}
    levels: list[tuple[DataFrame, list[str]]] = []
    if settings.use_holidays:
        profiles["company"] = work.keep(holidays.estimate(company_rows, ALL, calendar, holidays.K_COMPANY).drop("all"), "company_profile")
        levels = [(profiles["company"], [])]
        profiles["material"] = work.keep(holidays.estimate(past.material_rows, ["material_no"], calendar, holidays.K_MATERIAL, levels), "material_profile")
        levels = [(profiles["material"], ["material_no"]), *levels]
        modelled = rows.join(classes.where(F.col("demand_class") != classify.DORMANT).select(*keys), keys, "left_semi")
        profiles["key"] = work.keep(holidays.estimate(modelled, keys, calendar, settings.holiday_k, levels), "key_profile")
        levels = [(profiles["key"], keys), *levels]

    def freed(each: DataFrame, found: list) -> DataFrame:
        known = each.where("not is_backlog")
        return holidays.with_factor(known, calendar, found).withColumn("y", F.col("y") / F.col("factor")).drop("factor") if found else known

    # The company.
    base = _forecast(freed(company_rows, levels[-1:]), company_class, ALL, steps, settings, True).select("date", "base")
    ahead = overall_window.join(base, "date", "left").fillna(0.0, ["base"])
    ahead = holidays.with_factor(ahead, calendar, levels[-1:]).withColumnRenamed("factor", "hf") if levels else ahead.withColumn("hf", F.lit(1.0))
    booked = total.where(F.col("date") > F.lit(as_of)).select("date", F.col("y").alias("backlog"))
    nothing = F.lit(0.0).alias("backlog")
    company = ahead.join(booked, "date", "left").fillna(0.0, ["backlog"]) if settings.include_backlog else ahead.select("*", nothing)
    company = company.withColumn("model", F.col("base") * F.col("hf")).withColumns({"additional": F.greatest(F.col("model") - F.col("backlog"), F.lit(0.0)), "initial": F.greatest("model", "backlog")})
    company = work.keep(company, "company")

    # Every key: base times factor, zero where no model could be fitted.
    fitted = work.keep(_forecast(freed(rows, levels), classes, keys, steps, settings, settings.thorough), "fitted")
    grid = classes.select(*keys, "demand_class").crossJoin(F.broadcast(window))  # the window's days
    grid = grid.join(fitted.select(*keys, "date", "base"), [*keys, "date"], "left").withColumn("has_model", F.col("base").isNotNull()).fillna(0.0, ["base"])
    grid = holidays.with_factor(grid, calendar, levels).withColumn("hf", F.when(F.col("has_model"), F.col("factor")).otherwise(1.0)).drop("factor") if levels else grid.withColumn("hf", F.lit(1.0))
    own = daily.where(F.col("date") > F.lit(as_of)).select(*keys, "date", F.col("y").alias("backlog"))
    grid = grid.join(own, [*keys, "date"], "left").fillna(0.0, ["backlog"]) if settings.include_backlog else grid.select("*", nothing)
    model = grid.withColumn("m", F.col("base") * F.col("hf"))
    if settings.weekday_shaping:
        model = reconcile.shape_weekdays(model, stats, keys).drop("week", "dow", "mean", "std", "cap")
    detail = work.keep(model.select(*keys, "date", "base", "hf", "m", "backlog", "has_model", "demand_class"), "detail")
    target = company.join(F.broadcast(window), "date", "left_semi").select("date", "model")
    out = work.keep(reconcile.reconcile(detail.drop("base", "demand_class"), target, stats, classes, keys, by, settings.max_cut), "reconciled")
    return Run(keys, as_of, days, company, detail, out, classes, fitted.select(*keys, "model").distinct(), calendar, profiles, work)


def context(run: Run) -> DataFrame:
    """(keys, date, slot, hf, own): the holiday slot of each key and day, its factor, and whether it rests on own evidence."""
    marked = run.detail.select(*run.keys, "date", "hf").join(F.broadcast(run.calendar.select("date", "slot")), "date", "left")
    if "key" not in run.profiles:
        return marked.withColumn("own", F.lit(False))
    evidence = run.profiles["key"].select(*run.keys, "slot", "n_obs")
    return marked.join(evidence, [*run.keys, "slot"], "left").select(*run.keys, "date", "slot", "hf", (F.coalesce("n_obs", F.lit(0.0)) >= 1).alias("own"))


def holiday_texts(run: Run) -> DataFrame:
    """Each key's strongest holiday factors in words."""
    every = run.classes.select(*run.keys).join(run.fitted.select(*run.keys, F.lit(True).alias("has_model")), run.keys, "left").fillna(False, ["has_model"])
    if "key" not in run.profiles:
        return every.select(*run.keys, F.when(F.col("has_model"), "No material holiday effects (all within +/-10%)").otherwise("n/a (no model)").alias("holidays"))
    return holidays.summary_text(run.profiles["key"], run.keys, every)


def class_models(run: Run) -> DataFrame:
    """(keys, model): the model that each key's class asks for."""
    model: Column = F.lit(None).cast("string")
    for kind, name in classify.MODELS.items():
        model = F.when(F.col("demand_class") == kind, F.lit(name)).otherwise(model)
    return run.classes.select(*run.keys, model.alias("model"))


def weekly_sheet(run: Run) -> DataFrame:
    slots = run.company.select("date", F.col("hf").alias("factor")).join(F.broadcast(run.calendar.select("date", "slot")), "date", "left")
    return reports.weekly_overall(run.company, run.reconciled, slots)


def holdout(lines: DataFrame, cutoff: dt.date, horizon: int, keys: list[str] | None = None, settings: Settings | None = None, work: Workspace | None = None) -> DataFrame:
    """(metric, With holiday effects, Without holiday effects): errors of a forecast made at the cutoff, without backlog.

    Both variants share one history. The result reads the tables of `work`.
    """
    settings = settings or Settings()
    days = [cutoff + dt.timedelta(k) for k in range(1, horizon + 1)]
    window = _window(lines.sparkSession, days)
    past = prepare(lines, cutoff, days[-1], keys, settings, work)
    actual_company = window.join(past.total.select("date", "y"), "date", "left").fillna(0.0, ["y"])
    own = company = None
    for label, flag in zip(VARIANTS, (True, False), strict=True):
        run = build(lines, cutoff, days, history=past, settings=Settings(**{**settings.__dict__, "use_holidays": flag, "include_backlog": False}))
        mine = run.reconciled.select(*run.keys, "date", "m", "model_final", F.lit(label).alias("variant"))
        whole = run.company.select("date", F.col("model").alias("m"), F.lit(label).alias("variant"))
        own, company = (mine, whole) if own is None else (own.unionByName(mine), company.unionByName(whole))
    # The variant is a key from here on: every measure is one aggregate over both. Classes do not depend on it.
    actual = reports.actual_matrix(past.daily, run.classes, run.keys, window)
    own, company = actual.join(own, [*run.keys, "date"]), actual_company.join(company, "date")
    sums, week = [F.sum("y").alias("y"), F.sum("m").alias("m")], series.week_end(F.col("date")).alias("week")
    by = lambda df, *more: df.groupBy("variant", *more)
    error = lambda p, k=0: forecasts.fraction_errors(F.col("y"), F.col(p))[k]
    covered = by(own, "date").agg(*sums)
    measures = [
        by(company).agg(error("m").alias("company daily WAPE"), error("m", 1).alias("company bias")),
        by(by(company, week).agg(*sums)).agg(error("m").alias("company weekly WAPE")),
        by(covered).agg(error("m").alias("covered keys daily WAPE before reconciliation")),
        by(by(covered, week).agg(*sums)).agg(error("m").alias("covered keys weekly WAPE before reconciliation")),
        by(own).agg(error("model_final").alias("key daily WAPE reconciled")),
        by(by(own, *run.keys).agg(*sums, F.sum("model_final").alias("model_final"))).agg(error("model_final").alias("key horizon WAPE reconciled"), error("m").alias("key horizon WAPE before reconciliation")),
    ]
    values = measures[0]
    for more in measures[1:]:
        values = values.join(more, "variant")
    return reports.variant_pivot(values.unpivot("variant", [c for c in values.columns if c != "variant"], "metric", "value"), VARIANTS)


def export(run: Run, path: str, reasoning: bool = True, backtest: DataFrame | None = None) -> None:
    """The run as a workbook: forecast, weekly company sheet, reconciliation by day and week, holiday effects, reasons, holdout."""
    names = [str(d) for d in run.days]
    wide = reports.wide_forecast(run.reconciled, run.keys, names)
    sheets = {"Forecast": wide.orderBy(*run.keys), "Overall Forecast (Weekly)": weekly_sheet(run).orderBy("week_end")}
    sheets["Reconciliation"] = reconcile.summary(run.reconciled, run.company.select("date", "model", "initial")).orderBy("date")
    sheets["Reconciliation (Weekly)"] = reconcile.blocks(run.reconciled, run.company, run.keys).orderBy("week")
    if run.profiles:
        slots = [r["slot"] for r in run.calendar.select("slot").distinct().orderBy("slot").collect()]  # names of a calendar
        sheets["Holiday Effects"] = reports.holiday_effects(run.profiles["company"], run.profiles["material"], slots).orderBy("level", "material_no")
    groups = {}
    if reasoning:
        told = reconcile.daily_reasons(run.reconciled, run.keys, context(run), class_models(run))
        fields = ["parts", "adj", "final", "reason"]
        each = told.withColumn("_day", F.date_format("date", "yyyy-MM-dd")).groupBy(*run.keys).pivot("_day", names).agg(*(F.first(f).alias(f) for f in fields))
        known = run.classes.select(*run.keys, "demand_class", "days_since", "span_days", F.round("recent_avg", 1).alias("recent_avg")).join(class_models(run), run.keys).join(holiday_texts(run), run.keys)
        sheets["Reasoning"] = known.join(each, run.keys).orderBy(*run.keys)
        groups["Reasoning"] = [("Combination", len(known.columns)), *((n, len(fields)) for n in names)]
    if backtest is not None:
        sheets["Backtest"] = backtest.orderBy("metric")
    form = {"Holiday Effects": xlsx.THOUSANDTH, "Reasoning": xlsx.TENTH, "Backtest": xlsx.TENTH}
    still = {"Forecast": (len(run.keys), 1), "Reconciliation": (1, 1), "Reconciliation (Weekly)": (2, 1), "Holiday Effects": (2, 1), "Reasoning": (len(run.keys), 1)}
    numbers = lambda df: [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int") or t.startswith("decimal")]
    looks = {n: xlsx.Look({c: form.get(n, xlsx.WHOLE) for c in numbers(df)}, None, still.get(n, (0, 1)), {c: 24 for c in run.keys if c in df.columns}) for n, df in sheets.items()}
    xlsx.write_frames(path, sheets, groups, looks)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description="Reconciled forecast of every combination in an order workbook.")
    p.add_argument("--workbook", required=True)
    p.add_argument("--out", default="reconciled_forecast.xlsx")
    p.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    p.add_argument("--horizon", type=int, default=21)
    p.add_argument("--align-to-sunday", action="store_true")
    p.add_argument("--forecast-start-date", type=dt.date.fromisoformat)
    p.add_argument("--weekly-start-date", type=dt.date.fromisoformat)
    p.add_argument("--weekly-horizon-weeks", type=int)
    p.add_argument("--thorough-arima", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--dormant-inactivity-days", type=int, default=classify.DORMANT_DAYS)
    p.add_argument("--new-min-history-days", type=int, default=classify.NEW_DAYS)
    p.add_argument("--regular-density-threshold", type=float, default=classify.DENSITY)
    p.add_argument("--holiday-k", type=float, default=holidays.K_COMBO)
    p.add_argument("--max-cut-frac", type=float, default=reconcile.MAX_CUT)
    p.add_argument("--no-weekday-shaping", action="store_true")
    p.add_argument("--no-holidays", action="store_true")
    p.add_argument("--no-reasoning", action="store_true")
    p.add_argument("--backtest", action="store_true")
    p.add_argument("--backtest-cutoff", type=dt.date.fromisoformat)
    a = p.parse_args(arguments)
    if spark is None:
        from ..session import session

        spark = session()
    as_of = a.as_of or dt.date.today()
    start = a.forecast_start_date or series.forecast_start(as_of, a.align_to_sunday)
    weekly = a.weekly_start_date or start + dt.timedelta((6 - start.weekday()) % 7)
    if start <= as_of or weekly <= as_of or weekly.weekday() != 6:
        p.error("the forecast must start after the as-of day, and the weekly sheet on a Sunday after it")
    days = [start + dt.timedelta(k) for k in range(a.horizon)]
    weeks = a.weekly_horizon_weeks or max(1, -(-a.horizon // 7))
    last = max(days[-1], weekly + dt.timedelta(7 * weeks - 1))
    overall = [min(start, weekly) + dt.timedelta(k) for k in range((last - min(start, weekly)).days + 1)]
    settings = Settings(not a.no_holidays, True, not a.no_weekday_shaping, a.thorough_arima, a.holiday_k, a.max_cut_frac, a.dormant_inactivity_days, a.new_min_history_days, a.regular_density_threshold, a.limit)
    lines = loading.load_workbook(spark, a.workbook, reconciled=True).rows
    run = build(lines, as_of, days, overall, settings=settings)
    held = run.work.part("holdout")
    tested = holdout(lines, a.backtest_cutoff or as_of - dt.timedelta(a.horizon), a.horizon, settings=settings, work=held) if a.backtest else None
    export(run, a.out, not a.no_reasoning, tested)
    run.work.close()


if __name__ == "__main__":
    main()
