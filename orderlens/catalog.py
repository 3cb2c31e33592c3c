"""Named queries of the demand engine on the test tables, and equivalent SQL for checking them."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import samples
from .functions import cleaning as c
from .operators import boosted, classify, events, features, forecasts, holidays, ingest, models, reconcile, reports, selection, series
from .plans import batch, reconciled
from .plans.order_lines import AS_OF, HORIZON, KEYS, WEEKS, material_lines, order_lines
from .sources import store
from .workspace import Workspace, shared_folder

MAT = ["customer", "material_no"]
MAT_RUN = [dt.date.fromisoformat(AS_OF) + dt.timedelta(k) for k in range(1, WEEKS + 1)]


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _texts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(id, raw): a text for each order line, as exports hold them: one of the kind's forms with the line's own value in it."""
    forms, mark, value = samples.TEXTS[kind]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.expr(value).alias("_value"))
    form = F.element_at(F.array(*(F.lit(x).cast("string") for x in forms)), (F.col("id") % len(forms) + 1).cast("int"))
    return line.select("id", F.replace(form, F.lit(mark), F.col("_value")).alias("raw"))


def _events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(dt.date.fromisoformat(d), p) for d, p in samples.EVENTS], "date date, uplift_pct double")


def _history(spark, sf_dir):
    return series.modelling_series(order_lines(spark, sf_dir), KEYS, AS_OF)


def _backlog(spark, sf_dir, keys=KEYS, lines=order_lines):
    return series.daily_sum(lines(spark, sf_dir).where(F.col("date") > F.lit(AS_OF).cast("date")), keys)


# --- ingest -----------------------------------------------------------------------------------------------------


def header_tokens(spark, sf_dir):
    return _texts(spark, sf_dir, "headers").select("id", c.token(F.col("raw")).alias("token"))


def number_parse(spark, sf_dir):
    return _texts(spark, sf_dir, "numbers").withColumn("n", c.parse_number(F.col("raw"))).select("id", "n.value", "n.reason")


def id_clean(spark, sf_dir):
    return _texts(spark, sf_dir, "ids").select("id", c.clean_id(F.col("raw")).alias("clean"))


def day_parse(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.to_date("l_shipdate").alias("day"))
    nth = F.col("id") % len(samples.DAY_TEXTS)
    form = F.coalesce(*(F.when(nth == k, F.date_format("day", f)) for k, (f, _) in enumerate(samples.DAY_TEXTS)))  # each line's own form alone is written
    return lines.withColumn("raw", form).select("id", c.parse_day(F.col("raw")).alias("date"))


def half_year_sheets(spark, sf_dir):
    key = c.half_year_key(F.col("raw"))
    return _texts(spark, sf_dir, "sheets").select("id", c.is_half_year(F.col("raw")).alias("accepted"), key["year"].cast("bigint").alias("year"), key["half"].cast("bigint").alias("half"))


def _dirty(spark, sf_dir):
    """The lines as an export would hold them: pounds as text with commas and units, some unreadable, some rows twice."""
    lines = order_lines(spark, sf_dir)
    pounds = F.when(F.col("order_no") % 97 == 0, "n/a").when(F.col("order_no") % 89 == 0, "1.2.3").when(F.col("order_no") % 2 == 0, F.concat(F.col("net_pounds").cast("int").cast("string"), F.lit(" lbs"))).otherwise(F.concat(F.lit("0,"), F.col("net_pounds").cast("int").cast("string")))
    day = F.when(F.col("order_no") % 83 == 0, "soon").otherwise(F.date_format("date", "yyyy-MM-dd"))
    sheet = lines.select("sheet", "customer", "material_group", "material_no", "plant", "order_no", day.alias("day_text"), pounds.alias("pounds_text"))
    again = sheet.where(F.col("order_no") % 50 == 0).withColumn("sheet", F.lit("99H2"))
    both = ingest.union_sheets([sheet, again])
    return both.withColumns({"date": c.parse_day(F.col("day_text")), "number": c.parse_number(F.col("pounds_text"))})


def dq_report(spark, sf_dir):
    return ingest.quality_report(_dirty(spark, sf_dir))


def dq_numeric(spark, sf_dir):
    """Measures and ids of numeric columns, large and small, as Parquet sheets hold them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    measure = F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice") * 1000).when(F.col("l_linenumber") == 2, F.col("l_discount") / 1000).when(F.col("l_linenumber") == 3, F.lit(float("nan"))).when(F.col("l_linenumber") < 6, -F.col("l_quantity"))
    sheet = lines.select("l_orderkey", "l_linenumber", measure.cast("double").alias("measure"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey") * 1e6).otherwise(F.col("l_partkey") + 0.5).alias("id"))
    return sheet.withColumn("n", c.parse_number(F.col("measure"))).select("l_orderkey", "l_linenumber", "n.value", "n.reason", c.clean_id(F.col("id")).alias("id"))


def exact_dedup(spark, sf_dir):
    kept = ingest.drop_exact_duplicates(ingest.valid_rows(_dirty(spark, sf_dir)))
    return kept.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.sum("net_pounds").alias("pounds"))


def dup_count(spark, sf_dir):
    return ingest.count_exact_duplicates(ingest.valid_rows(_dirty(spark, sf_dir)))


# --- series -----------------------------------------------------------------------------------------------------


def daily_total(spark, sf_dir):
    return series.daily_sum(order_lines(spark, sf_dir), [])


def daily_by_segment(spark, sf_dir):
    return series.daily_sum(order_lines(spark, sf_dir), KEYS)


def overall_grouping_sets(spark, sf_dir):
    return series.daily_with_overall(order_lines(spark, sf_dir), KEYS)


def filtered_daily(spark, sf_dir):
    return series.daily_sum(series.filtered(order_lines(spark, sf_dir), customer="BUILDING", material_group=None), [])


def segment_options(spark, sf_dir):
    return order_lines(spark, sf_dir).groupBy("customer").agg(F.array_join(F.array_sort(F.collect_set("material_group")), ", ").alias("groups"), F.countDistinct("material_group").alias("n"))


def segment_list(spark, sf_dir):
    return series.segments(order_lines(spark, sf_dir), KEYS, 10)


def dense_calendar(spark, sf_dir):
    return series.dense(series.daily_sum(order_lines(spark, sf_dir), KEYS), KEYS)


def _gaps(treatment):
    def query(spark, sf_dir):
        return _r(series.fill_gaps(series.dense(series.daily_sum(order_lines(spark, sf_dir), MAT), MAT), MAT, treatment), "y")

    return query


def missing_dates(spark, sf_dir):
    return series.dense(series.daily_sum(order_lines(spark, sf_dir), MAT), MAT).where("y is null").select(*MAT, "date")


def asof_split(spark, sf_dir):
    split = series.split_as_of(series.daily_sum(order_lines(spark, sf_dir), KEYS), AS_OF)
    return split.groupBy(*KEYS, "is_backlog").agg(F.count(F.lit(1)).alias("days"), F.sum("y").alias("pounds"))


def _zero(spark, sf_dir, lines=order_lines, keys=MAT):
    return series.zero_filled(series.daily_sum(lines(spark, sf_dir), keys), keys, AS_OF)


def zero_filled_series(spark, sf_dir):
    return _zero(spark, sf_dir)


def weekly_resample(spark, sf_dir):
    return reports.weekly(series.daily_sum(order_lines(spark, sf_dir), KEYS), KEYS)


# --- windows ----------------------------------------------------------------------------------------------------


def feature_matrix(spark, sf_dir):
    out = features.feature_matrix(_history(spark, sf_dir), KEYS, ["2000-03-14", "2000-10-31"]).drop("i", "n")
    return _r(out, "y", *[x for x in out.columns if x.startswith(("lag", "mean", "std", "sin", "cos"))])


def rolling_means(spark, sf_dir):
    return _r(features.rolling_means(_history(spark, sf_dir), KEYS).drop("i", "n"), "y", "mean_7", "mean_14", "mean_28")


def weekday_profile(spark, sf_dir):
    return _r(features.weekday_profile(_history(spark, sf_dir), KEYS), "mean")


def centered_baseline(spark, sf_dir):
    rows = _zero(spark, sf_dir).where("not is_backlog")
    return _r(rows.select(*MAT, "date", features.centred_mean(F.col("y"), MAT).alias("baseline")), "baseline")


def seasonal_diff_scale(spark, sf_dir):
    return _r(forecasts.mase_scale(_history(spark, sf_dir), KEYS), "scale")


# --- forecasts --------------------------------------------------------------------------------------------------


def seasonal_naive(spark, sf_dir):
    return _r(forecasts.seasonal_naive(_history(spark, sf_dir), KEYS, HORIZON), "yhat", "lower", "upper")


def backtest_origins(spark, sf_dir):
    return forecasts.origins(_history(spark, sf_dir), KEYS, HORIZON)


def backtest_rows(spark, sf_dir):
    return _r(forecasts.backtest(_history(spark, sf_dir), KEYS, HORIZON), "y", "yhat")


def _measures(spark, sf_dir):
    rows = _history(spark, sf_dir)
    return forecasts.metrics(forecasts.backtest(rows, KEYS, HORIZON), forecasts.mase_scale(rows, KEYS), KEYS)


MEASURES = ["wape", "mae", "rmse", "smape", "mase", "bias", "abs_pct_bias", "accuracy"]


def metrics_by_segment(spark, sf_dir):
    return _r(_measures(spark, sf_dir), *MEASURES)


def leaderboard(spark, sf_dir):
    return _r(selection.leaderboard(_measures(spark, sf_dir), KEYS).select(*KEYS, "model", "rank", "wape"), "wape")


def recommended_model(spark, sf_dir):
    return _r(selection.recommend(_measures(spark, sf_dir), KEYS), "best_wape", "naive_wape")


def best_by_wape(spark, sf_dir):
    return _r(selection.best_by_wape(_measures(spark, sf_dir), KEYS), "wape")


def multi_model_wide(spark, sf_dir):
    rows = forecasts.backtest(_history(spark, sf_dir), KEYS, HORIZON)
    wide = reports.wide_models(rows, KEYS, ["Seasonal Naive", "Weekday Mean", "Trailing Mean"])
    return _r(wide.toDF(*KEYS, "date", "seasonal_naive", "weekday_mean", "trailing_mean", "average"), "seasonal_naive", "weekday_mean", "trailing_mean", "average")


def ensemble_average(spark, sf_dir):
    """Each model floored by backlog, then averaged."""
    naive = forecasts.seasonal_naive(_history(spark, sf_dir), KEYS, HORIZON).select(*KEYS, "date", "yhat")
    flat = _history(spark, sf_dir).where(F.col("i") > F.col("n") - 28).groupBy(*KEYS).agg(F.avg("y").alias("yhat"), F.max("date").alias("_last"))
    flat = flat.select(*KEYS, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", HORIZON))).alias("date"), "yhat")
    floored = events.with_backlog(naive.unionByName(flat), _backlog(spark, sf_dir), KEYS)
    return _r(floored.groupBy(*KEYS, "date").agg(F.avg("combined").alias("average")), "average")


# --- events -----------------------------------------------------------------------------------------------------


def event_text(spark, sf_dir):
    rows = _texts(spark, sf_dir, "events")
    return rows.select("id", F.explode(events.parse_events(F.col("raw"))).alias("date"))


def event_merge(spark, sf_dir):
    """A user's list as long as the order lines: many percentages a day, some missing."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return events.merge_events(lines.select(F.to_date("l_shipdate").alias("date"), F.when(F.col("l_linenumber") > 2, F.col("l_discount") * 100).alias("uplift_pct")))


def event_classes(spark, sf_dir):
    history = series.daily_sum(order_lines(spark, sf_dir), []).where(F.col("date") <= F.lit(AS_OF).cast("date"))
    horizon = spark.range(1, HORIZON + 1).select(F.date_add(F.lit(AS_OF).cast("date"), F.col("id").cast("int")).alias("date"))
    return events.classify_events(events.merge_events(_events(spark)), history, horizon)


def _past_events(spark):
    return events.merge_events(_events(spark)).where(F.col("date") <= F.lit(AS_OF).cast("date"))


def _variance(spark, sf_dir):
    return events.date_variance(_history(spark, sf_dir), _past_events(spark), KEYS)


def date_variance(spark, sf_dir):
    return _r(_variance(spark, sf_dir), "baseline", "variance_pct", "actual")


def overall_uplift(spark, sf_dir):
    return _r(events.overall_uplift(_variance(spark, sf_dir), KEYS), "overall_pct")


def _resolved(spark, sf_dir, rows=None):
    future = events.merge_events(_events(spark)).where(F.col("date").between(F.date_add(F.lit(AS_OF).cast("date"), 1), F.date_add(F.lit(AS_OF).cast("date"), HORIZON)))
    rows = _history(spark, sf_dir) if rows is None else rows
    return events.resolve_uplifts(future, events.date_variance(rows, _past_events(spark), KEYS), KEYS, segments=rows.where(F.col("n") >= forecasts.SEASON))


def resolved_uplift(spark, sf_dir):
    return _r(_resolved(spark, sf_dir).select(*KEYS, "date", "resolved_pct", "method", F.size("breakdown").cast("bigint").alias("n_analogs")), "resolved_pct")


def uplift_ramp(spark, sf_dir):
    return _r(events.ramp(_resolved(spark, sf_dir), KEYS), "share")


def _projection(spark, sf_dir):
    return events.with_backlog(forecasts.seasonal_naive(_history(spark, sf_dir), KEYS, HORIZON), _backlog(spark, sf_dir), KEYS)


def combined_projection(spark, sf_dir):
    return _r(_projection(spark, sf_dir).select(*KEYS, "date", "yhat", "backlog", "combined"), "yhat", "backlog", "combined")


def adjusted_forecast(spark, sf_dir):
    out = events.adjusted(_projection(spark, sf_dir), events.ramp(_resolved(spark, sf_dir), KEYS), KEYS)
    return _r(out.select(*KEYS, "date", "combined", "share", "final_forecast"), "combined", "share", "final_forecast")


def final_forecast_table(spark, sf_dir):
    return reports.stamped(reports.final_table(events.adjusted(_projection(spark, sf_dir), events.ramp(_resolved(spark, sf_dir), KEYS), KEYS), KEYS, "Seasonal Naive"), dt.datetime.fromisoformat(AS_OF))


def final_forecast_models(spark, sf_dir):
    """The final table of two models together."""
    rows = Workspace(spark, "history").keep(_history(spark, sf_dir), "rows")
    naive = forecasts.seasonal_naive(rows, KEYS, HORIZON).select(*KEYS, "date", "yhat", F.lit("Seasonal Naive").alias("model"))
    flat = rows.where(F.col("i") > F.col("n") - 28).groupBy(*KEYS).agg(F.avg("y").alias("yhat"))
    both = naive.unionByName(naive.select(*KEYS, "date").join(flat, KEYS).withColumn("model", F.lit("Trailing Mean")))
    return reports.final_table(events.adjusted(events.with_backlog(both, _backlog(spark, sf_dir), KEYS), events.ramp(_resolved(spark, sf_dir, rows), KEYS), KEYS), KEYS)


def actual_forecast_wide(spark, sf_dir):
    ahead = events.adjusted(_projection(spark, sf_dir), events.ramp(_resolved(spark, sf_dir), KEYS), KEYS).withColumn("model", F.lit("Seasonal Naive"))
    wide = reports.wide_actual_forecast(_history(spark, sf_dir), ahead, KEYS, ["Seasonal Naive"], 30)
    return _r(wide.select(*KEYS, "date", "type", F.col("Actual").alias("actual"), F.col("Seasonal Naive").alias("seasonal_naive"), F.col("Average").alias("average"), "place"), "actual", "seasonal_naive", "average")


def actual_matrix(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    window = spark.createDataFrame([(dt.date(2001, 7, 10) + dt.timedelta(k),) for k in range(1, WEEKS + 1)], "date date")
    return reports.actual_matrix(series.daily_sum(lines, KEYS), lines, KEYS, window)


def actual_vs_forecast(spark, sf_dir):
    return _r(reports.actual_vs_forecast(_history(spark, sf_dir), forecasts.seasonal_naive(_history(spark, sf_dir), KEYS, HORIZON), KEYS), "value")


# --- classes, holidays, reconciliation --------------------------------------------------------------------------


def segment_profile(spark, sf_dir):
    return _r(classify.profiles(_zero(spark, sf_dir, material_lines), MAT, AS_OF), "recent_avg", "density")


def weekday_stats(spark, sf_dir):
    return _r(classify.weekday_stats(_zero(spark, sf_dir, material_lines), MAT), "mean", "std", "cap")


def class_counts(spark, sf_dir):
    return classify.class_counts(classify.profiles(_zero(spark, sf_dir, material_lines), MAT, AS_OF))


def _days(spark, sf_dir):
    """Holiday days from `PADDING` days before the first order to as many past the last day ahead."""
    first = order_lines(spark, sf_dir).agg(F.min("date")).first()[0]
    return holidays.calendar(spark, first - dt.timedelta(holidays.PADDING), MAT_RUN[-1] + dt.timedelta(holidays.PADDING))


def holiday_calendar(spark, sf_dir):
    return _days(spark, sf_dir)


def _profiles(spark, sf_dir, levels: int):
    """Holiday profiles of the company, of materials and of customers' materials, each written before the next reads it."""
    work, days, found = Workspace(spark, "profiles"), _days(spark, sf_dir), []
    kinds = [(["all"], holidays.K_COMPANY), (["material_no"], holidays.K_MATERIAL), (MAT, holidays.K_COMBO)][:levels]
    daily = series.daily_sum(order_lines(spark, sf_dir), [x for x in kinds[-1][0] if x != "all"])
    daily = work.keep(daily, "daily") if levels > 1 else daily
    for keys, k in kinds:
        rows = daily.withColumn("all", F.lit("all")).groupBy(*keys, "date").agg(F.sum("y").alias("y"))
        profile = work.keep(holidays.estimate(series.zero_filled(rows, keys, AS_OF), keys, days, k, found).drop("all"), f"profile{len(found)}")
        found = [(profile, [x for x in keys if x != "all"]), *found]
    return [p for p, _ in reversed(found)]


def holiday_profile_company(spark, sf_dir):
    return _r(_profiles(spark, sf_dir, 1)[0].select("slot", "factor", "n_obs"), "factor", "n_obs")


def holiday_profile_material(spark, sf_dir):
    return _r(_profiles(spark, sf_dir, 2)[1], "factor", "n_obs")


def holiday_profile_combo(spark, sf_dir):
    """Rows of the third level: customer and material, shrunk to the material, then to the company."""
    return _r(_profiles(spark, sf_dir, 3)[2], "factor", "n_obs")


def holiday_effects_wide(spark, sf_dir):
    company, material = _profiles(spark, sf_dir, 2)
    slots = [r["slot"] for r in _days(spark, sf_dir).select("slot").distinct().orderBy("slot").collect()]  # 33 names
    return reports.holiday_effects(company, material, slots)


def _run(spark, sf_dir, by="week", lines=material_lines):
    """The reconciled run with the seasonal naive in place of the fitted models, so that SQL can follow it."""
    return reconciled.build(lines(spark, sf_dir), dt.date.fromisoformat(AS_OF), MAT_RUN, keys=MAT, settings=reconciled.Settings(naive_only=True), by=by)


def holiday_text(spark, sf_dir):
    return reconciled.holiday_texts(_run(spark, sf_dir, lines=order_lines))


def holiday_model_layer(spark, sf_dir):
    """A forecast of the series freed of three levels of holiday factors, times the factors of the days ahead."""
    rows = _run(spark, sf_dir, lines=order_lines).detail
    return _r(rows.select(*MAT, "date", "base", F.col("hf").alias("factor"), (F.col("base") * F.col("hf")).alias("model")), "base", "factor", "model")


def weekday_shaping(spark, sf_dir):
    return _r(_run(spark, sf_dir).detail.select(*MAT, "date", "m"), "m")


def reconcile_weekly(spark, sf_dir):
    return _r(_run(spark, sf_dir).reconciled.select(*MAT, "date", "m", "adj", "model_final", "final"), "m", "adj", "model_final", "final", digits=4)


def reconcile_daily(spark, sf_dir):
    return _r(_run(spark, sf_dir, "day").reconciled.select(*MAT, "date", "m", "adj", "model_final", "final"), "m", "adj", "model_final", "final", digits=4)


def recon_summary(spark, sf_dir):
    run = _run(spark, sf_dir)
    found = reconcile.summary(run.reconciled, run.company.select("date", "model", "initial"))
    return _r(found, *[x for x in found.columns if x != "date"], digits=3)


def recon_blocks(spark, sf_dir):
    run = _run(spark, sf_dir)
    found = reconcile.blocks(run.reconciled, run.company, MAT)
    return _r(found, *[x for x in found.columns if x not in ("week", "first_day", "last_day", "days", "eligible", "adjusted")], digits=3)


def weekly_overall(spark, sf_dir):
    return _r(reconciled.weekly_sheet(_run(spark, sf_dir)), "backlog", "additional", "total", "detail", "difference", "excess", "unresolved", digits=3)


def reasoning_text(spark, sf_dir):
    return reconcile.reasons(_run(spark, sf_dir).reconciled, MAT)


def wide_forecast(spark, sf_dir):
    return reports.wide_forecast(_run(spark, sf_dir).reconciled, MAT, [str(d) for d in MAT_RUN])


def reasoning_daily(spark, sf_dir):
    run = _run(spark, sf_dir)
    return reconcile.daily_reasons(run.reconciled, MAT, reconciled.context(run), reconciled.class_models(run))


def reconciled_forecast(spark, sf_dir):
    """The reconciled run with the fitted models of the demand classes."""
    run = reconciled.build(material_lines(spark, sf_dir), dt.date.fromisoformat(AS_OF), MAT_RUN, keys=MAT)
    return run.reconciled.join(reconciled.class_models(run), MAT).select(*MAT, "date", "demand_class", "model", "has_model", "m", "adj", "model_final", "backlog", "final")


def holdout_variants(spark, sf_dir):
    """Errors of a forecast made three weeks back, with and without holiday effects."""
    lines = material_lines(spark, sf_dir).where(F.col("date") <= F.lit(AS_OF).cast("date"))
    found = reconciled.holdout(lines, dt.date(2001, 7, 10), WEEKS, MAT, reconciled.Settings(naive_only=True))
    return _r(found, *reconciled.VARIANTS)


def holdout_backtest(spark, sf_dir):
    """The horizon's true totals against a forecast made with the history before it, daily and in total."""
    cut = "2001-07-10"
    lines = order_lines(spark, sf_dir).where(F.col("date") <= F.lit(AS_OF).cast("date"))
    rows = series.numbered(series.zero_filled(series.daily_sum(lines, KEYS), KEYS, cut).where("not is_backlog"), KEYS)
    forecast = forecasts.seasonal_naive(rows, KEYS, WEEKS).select(*KEYS, "date", "yhat")
    actual = series.daily_sum(lines, KEYS)
    joined = forecast.join(actual, [*KEYS, "date"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    wape, bias = forecasts.fraction_errors(F.col("y"), F.col("yhat"))
    total = joined.groupBy(*KEYS).agg(F.sum("y").alias("ty"), F.sum("yhat").alias("tp"))
    return _r(joined.groupBy(*KEYS).agg(wape.alias("wape"), bias.alias("bias")).join(total, KEYS).select(*KEYS, "wape", "bias", (F.abs(F.col("tp") - F.col("ty")) / F.nullif("ty", F.lit(0.0))).alias("horizon_wape")), "wape", "bias", "horizon_wape")


# --- store and models -------------------------------------------------------------------------------------------


def _runs(spark, sf_dir):
    best = selection.best_by_wape(_measures(spark, sf_dir), KEYS).select(*KEYS, F.col("best_model_by_wape").alias("model"), F.round("wape", 6).alias("wape"))
    early = best.where(F.col("customer") != "BUILDING").withColumn("run_date", F.lit("2001-07-30"))
    late = best.where(F.col("customer") != "MACHINERY").withColumn("run_date", F.lit("2001-07-31"))
    return early.unionByName(late)


def latest_run(spark, sf_dir):
    return store.latest_run(_runs(spark, sf_dir))


def skip_done(spark, sf_dir):
    return store.not_done(order_lines(spark, sf_dir).select(*KEYS).distinct(), _runs(spark, sf_dir), "2001-07-31")


def upsert_run(spark, sf_dir):
    new = _runs(spark, sf_dir).where("run_date = '2001-07-31' and customer = 'BUILDING'").withColumn("model", F.lit("override"))
    return store.upsert(_runs(spark, sf_dir), new, ["run_date", *KEYS])


def committed_runs(spark, sf_dir):
    """The runs of `upsert_run`, each committed to a store of manifests, and read back through the newest one."""
    kept = store.Store(spark, f"{shared_folder(spark)}/orderlens/store-{uuid.uuid4().hex}")
    runs = Workspace(spark, "runs").keep(_runs(spark, sf_dir), "runs")
    for day in ("2001-07-30", "2001-07-31"):
        kept.commit({"runs": runs.where(F.col("run_date") == day).drop("run_date")}, day, KEYS)
    new = kept.table("runs").where("run_date = '2001-07-31' and customer = 'BUILDING'").withColumn("model", F.lit("override"))
    kept.commit({"runs": new.drop("run_date")}, "2001-07-31", KEYS)
    return kept.table("runs")


def ets_forecast(spark, sf_dir):
    return models.fit_panel(_history(spark, sf_dir), KEYS, HORIZON, ["AutoETS"])


def ets_recursion(spark, sf_dir):
    """Damped trend and weekly season smoothed with fixed parameters over every segment's whole history."""
    return _r(models.smoothed(_history(spark, sf_dir), KEYS, "AAdA", (0.2, 0.05, 0.1, 0.9)), "level", "slope", "season", "deviation", digits=4)


def arima_forecast(spark, sf_dir):
    return models.fit_panel(_history(spark, sf_dir), KEYS, HORIZON, ["AutoARIMA"])


def gbm_forecast(spark, sf_dir):
    return models.fit_panel(_history(spark, sf_dir), KEYS, HORIZON, ["HistGradientBoosting"])


def boosted_panel(spark, sf_dir):
    """Errors over each segment's last days: of one boosted model of all segments, of one for each, and of the last week again."""
    rows = Workspace(spark, "boosted").keep(_history(spark, sf_dir).where(F.col("n") >= 60 + HORIZON), "rows")
    panel = boosted.held_out_errors(rows, KEYS, HORIZON).withColumnRenamed("wape", "panel_wape")
    history, held = rows.where(F.col("i") <= F.col("n") - HORIZON), rows.where(F.col("i") > F.col("n") - HORIZON).select(*KEYS, "date", "y")
    each = models.fit_panel(history, KEYS, HORIZON, ["HistGradientBoosting", "Seasonal Naive"]).where("status = 'ok'").join(held, [*KEYS, "date"])
    wape = F.sum(F.abs(F.col("y") - F.col("yhat"))) / F.nullif(F.sum(F.abs("y")), F.lit(0.0)) * 100
    wide = each.groupBy(*KEYS).pivot("model", ["HistGradientBoosting", "Seasonal Naive"]).agg(wape)
    return panel.join(wide.toDF(*KEYS, "own_wape", "naive_wape"), KEYS, "left")


def model_status(spark, sf_dir):
    return models.fit_panel(_history(spark, sf_dir), KEYS, HORIZON, ["AutoETS", "Chronos-2"]).groupBy(*KEYS, "model", "status").agg(F.count("date").alias("days"))


def _batch(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    return batch.run(lines, dt.date.fromisoformat(AS_OF), HORIZON, series.segments(lines, KEYS))


def batch_summary(spark, sf_dir):
    return _batch(spark, sf_dir)["segment_summary"]


def batch_metrics(spark, sf_dir):
    """Backtests of the four batch models over all rolling origins of every segment and the total."""
    return _batch(spark, sf_dir)["segment_metrics"]


def batch_forecasts(spark, sf_dir):
    return _batch(spark, sf_dir)["segment_forecasts"]


def _naive_batch(spark, sf_dir):
    """The batch run with the seasonal naive alone, so that SQL can follow all of its tables."""
    lines = order_lines(spark, sf_dir)
    return batch.run(lines, dt.date.fromisoformat(AS_OF), HORIZON, series.segments(lines, KEYS), ["Seasonal Naive"])


def batch_naive_summary(spark, sf_dir):
    return _naive_batch(spark, sf_dir)["segment_summary"]


def batch_naive_metrics(spark, sf_dir):
    return _r(_naive_batch(spark, sf_dir)["segment_metrics"], "wape", "mae", "rmse", "smape", "mase", "bias", "abs_pct_bias", "accuracy_score")


def batch_naive_forecasts(spark, sf_dir):
    return _r(_naive_batch(spark, sf_dir)["segment_forecasts"], "seasonal_naive", "average", "known_backlog")


def _tested(spark, sf_dir):
    work = Workspace(spark, "backtest")
    rows = work.keep(_history(spark, sf_dir), "rows")
    tests = work.keep(models.backtest_panel(rows, KEYS, HORIZON), "tests")
    return models.roll_up(tests, forecasts.metrics(tests.where("error is null"), forecasts.mase_scale(rows, KEYS), KEYS), KEYS, models.BATCH, rows)


def model_leaderboard(spark, sf_dir):
    return selection.leaderboard(_tested(spark, sf_dir).drop("runtime_seconds"), KEYS)


def model_recommended(spark, sf_dir):
    return selection.recommend(_tested(spark, sf_dir), KEYS)


def naive_backtest(spark, sf_dir):
    """The fitted panel's backtest of the seasonal naive, which SQL windows give too."""
    work = Workspace(spark, "backtest")
    tests = models.backtest_panel(work.keep(_history(spark, sf_dir), "rows"), KEYS, HORIZON, ["Seasonal Naive"])
    return _r(tests.select(*KEYS, "window", "date", "y", "model", "yhat"), "y", "yhat")


gaps_keep, gaps_zero, gaps_interpolate = _gaps("keep"), _gaps("zero"), _gaps("linear")

QUERIES = {
    name: globals()[name]
    for name in """combined_projection header_tokens number_parse id_clean half_year_sheets dq_report exact_dedup dup_count daily_total
    daily_by_segment overall_grouping_sets filtered_daily segment_options segment_list dense_calendar gaps_keep gaps_zero gaps_interpolate
    missing_dates asof_split zero_filled_series weekly_resample feature_matrix rolling_means weekday_profile centered_baseline
    seasonal_diff_scale seasonal_naive backtest_origins backtest_rows metrics_by_segment leaderboard recommended_model best_by_wape
    multi_model_wide ensemble_average event_text event_merge event_classes date_variance overall_uplift resolved_uplift uplift_ramp
    adjusted_forecast final_forecast_table actual_vs_forecast segment_profile weekday_stats class_counts holiday_calendar
    holiday_profile_company holiday_profile_material holiday_profile_combo holiday_text holiday_effects_wide weekday_shaping
    reconcile_weekly reconcile_daily recon_summary recon_blocks weekly_overall reasoning_text wide_forecast reasoning_daily holiday_model_layer holdout_backtest latest_run skip_done
    upsert_run committed_runs dq_numeric boosted_panel ets_recursion ets_forecast arima_forecast gbm_forecast model_status day_parse final_forecast_models actual_forecast_wide actual_matrix
    reconciled_forecast holdout_variants batch_summary batch_metrics batch_forecasts batch_naive_summary batch_naive_metrics batch_naive_forecasts model_leaderboard model_recommended naive_backtest""".split()
}

from .catalog_sql import SQL  # noqa: E402
