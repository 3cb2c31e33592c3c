"""High-production events: parsing, classes, learned uplifts, the ramp, and the backlog floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import parse_day

RAMP = {-2: 0.25, -1: 0.5, 0: 1.0, 1: 0.5, 2: 0.25}
LOOKBACK_WEEKS = 8
MIN_BASELINE = 3
MIN_DATES = 2
ANALOG_DAYS = 7
DEFAULT_UPLIFT = 20.0


def parse_events(text: Column) -> Column:
    """Days named in a comma-separated text; what is no date is ignored."""
    days = F.transform(F.split(text, ","), parse_day)
    return F.filter(days, lambda d: d.isNotNull())


def merge_events(events: DataFrame) -> DataFrame:
    """One row a date; a given percentage beats none, the larger of two wins."""
    return events.groupBy("date").agg(F.max("uplift_pct").alias("uplift_pct"))


def classify_events(events: DataFrame, history: DataFrame, horizon: DataFrame) -> DataFrame:
    """historical, future or out_of_range, by the range of the history and the days of the horizon."""
    span = history.agg(F.min("date").alias("_low"), F.max("date").alias("_high"))
    marked = events.crossJoin(F.broadcast(span)).join(horizon.select("date", F.lit(True).alias("_in")).distinct(), "date", "left")  # span is one row
    kind = F.when(F.col("date").between(F.col("_low"), F.col("_high")), "historical").when(F.col("_in"), "future").otherwise("out_of_range")
    return marked.select("date", "uplift_pct", kind.alias("kind"))


def date_variance(series: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """For each event day of a series: its value against the mean of the same weekday in the eight weeks before, without other events."""
    known = series.where("y is not null")
    days = known.join(F.broadcast(events.select("date")), "date").select(*keys, F.col("date").alias("event_date"), F.col("y").alias("actual"))
    wanted = days.select("*", F.explode(F.sequence(F.lit(1), F.lit(LOOKBACK_WEEKS))).alias("_w")).withColumn("date", F.expr("date_sub(event_date, 7 * _w)"))
    base = wanted.join(F.broadcast(events.select("date")), "date", "left_anti").join(known.select(*keys, "date", "y"), [*keys, "date"])
    means = base.groupBy(*keys, "event_date", "actual").agg(F.avg("y").alias("baseline"), F.count("y").alias("n_baseline"))
    return means.where((F.col("n_baseline") >= MIN_BASELINE) & (F.col("baseline") > 0)).withColumn("variance_pct", (F.col("actual") - F.col("baseline")) / F.col("baseline") * 100)


def overall_uplift(variance: DataFrame, keys: list[str]) -> DataFrame:
    return variance.groupBy(*keys).agg(F.avg("variance_pct").alias("overall_pct"), F.count(F.lit(1)).alias("n_dates")).where(F.col("n_dates") >= MIN_DATES)


def day_of_year_distance(a: Column, b: Column) -> Column:
    """Days apart within a year of 365 days, around its end."""
    apart = F.abs(F.dayofyear(a) - F.dayofyear(b))
    return F.least(apart, F.lit(365) - apart)


def resolve_uplifts(future: DataFrame, variance: DataFrame, keys: list[str], default: float = DEFAULT_UPLIFT, segments: DataFrame | None = None) -> DataFrame:
    """A percentage for every future event of every key: given, else of analogous days, else overall, else the default.

    `segments` lists the keys; without it, those with a past event. `breakdown` holds the analogous days that were
    averaged and their variances, in order of date; it is empty for the other methods.
    """
    wanted = (variance if segments is None else segments).select(*keys).distinct().crossJoin(F.broadcast(future))  # future events are a short list of the user's
    near = wanted.where("uplift_pct is null").join(variance, keys).where(day_of_year_distance(F.col("date"), F.col("event_date")) <= ANALOG_DAYS)
    analog = near.groupBy(*keys, "date").agg(F.avg("variance_pct").alias("analog_pct"), F.array_sort(F.collect_list(F.struct("event_date", "variance_pct"))).alias("_analogs"))
    joined = wanted.join(analog, [*keys, "date"], "left").join(overall_uplift(variance, keys), keys, "left")
    method = F.when(F.col("uplift_pct").isNotNull(), "explicit").when(F.col("analog_pct").isNotNull(), "analog_average").when(F.col("overall_pct").isNotNull(), "overall_average").otherwise("flat_default")
    nothing = F.array().cast("array<struct<event_date:date,variance_pct:double>>")
    return joined.select(*keys, "date", F.coalesce("uplift_pct", "analog_pct", "overall_pct", F.lit(default)).alias("resolved_pct"), method.alias("method"), F.coalesce("_analogs", nothing).alias("breakdown"))


def ramp(uplifts: DataFrame, keys: list[str]) -> DataFrame:
    """Total share to add on each day around the events; overlaps add up."""
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("shift"), F.lit(w).alias("weight")) for k, w in RAMP.items())))
    spread = uplifts.select(*keys, "date", "resolved_pct", steps.alias("_s")).select(*keys, F.date_add("date", F.col("_s.shift")).alias("date"), (F.col("resolved_pct") / 100 * F.col("_s.weight")).alias("share"))
    return spread.groupBy(*keys, "date").agg(F.sum("share").alias("share"))


def with_backlog(forecast: DataFrame, backlog: DataFrame, keys: list[str]) -> DataFrame:
    """The larger of forecast and booked backlog; a day without backlog has 0."""
    joined = forecast.join(backlog.select(*keys, "date", F.col("y").alias("backlog")), [*keys, "date"], "left")
    return joined.withColumn("backlog", F.coalesce("backlog", F.lit(0.0))).withColumn("combined", F.greatest("yhat", "backlog"))


def adjusted(projection: DataFrame, ramped: DataFrame, keys: list[str]) -> DataFrame:
    joined = projection.join(ramped, [*keys, "date"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return joined.withColumn("final_forecast", F.col("combined") * (1 + F.col("share")))
