"""Weekday shaping, and bounded reconciliation of detailed forecasts with the company total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .classify import INTERMITTENT, NEW, REGULAR
from .series import week_start

TOLERANCE, MAX_CUT = 1.0, 0.5


def shape_weekdays(model: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Each week's total spread over its days by the key's own weekday means; unchanged without weights or total.

    `model` has (keys, date, m, has_model).
    """
    block = Window.partitionBy(*keys, "week")
    rows = model.withColumns({"week": week_start(F.col("date")), "dow": (F.dayofweek("date") - 1).cast("bigint")}).join(stats, [*keys, "dow"], "left")
    rows = rows.withColumns({"_w": F.coalesce("mean", F.lit(0.0))})
    rows = rows.withColumns({"_sw": F.sum("_w").over(block), "_total": F.sum("m").over(block)})
    ok = F.col("has_model") & (F.col("_sw") > 0) & (F.col("_total") > 0)
    return rows.withColumn("m", F.when(ok, F.col("_total") * F.col("_w") / F.col("_sw")).otherwise(F.col("m"))).drop("_w", "_sw", "_total")


def water_fill(rows: DataFrame, group: str) -> DataFrame:
    """Adds `alloc`: the group's |gap| shared in proportion to weight, each share capped by its room.

    The level is found from running sums in order of room over weight, so no rounds are needed. Running sums go over
    bands of that ratio first and inside a band then, so no group is sorted in one task. What the rooms cannot hold
    stays unallocated. `rows` has (group, gap, weight, room).
    """
    live = (F.col("weight") > 0) & (F.col("room") > 1e-9)
    ratio = F.col("room") / F.col("weight")
    marked = rows.withColumn("_ratio", F.when(live, ratio)).withColumn("_band", F.floor(F.log2("_ratio") * 16))
    bands = marked.where("_ratio is not null").groupBy(group, "_band").agg(F.sum("room").alias("_r"), F.sum("weight").alias("_wt"))
    rising = Window.partitionBy(group).orderBy("_band")
    bands = bands.withColumns({"_r0": F.coalesce(F.sum("_r").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_w1": F.coalesce(F.sum("_wt").over(rising.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))}).select(group, "_band", "_r0", "_w1")
    inside = Window.partitionBy(group, "_band").orderBy("_ratio", "weight", "room")
    level = marked.where("_ratio is not null").join(bands, [group, "_band"]).withColumns({"_before": F.col("_r0") + F.coalesce(F.sum("room").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_open": F.col("_w1") + F.sum("weight").over(Window.partitionBy(group, "_band")) - F.coalesce(F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    level = level.withColumn("_l", (F.abs(F.col("gap")) - F.col("_before")) / F.col("_open")).where("_l <= _ratio and _l >= 0").groupBy(group).agg(F.max("_l").alias("_level"))
    full = F.when(F.col("_level").isNull(), F.col("room")).otherwise(F.least(F.col("_level") * F.col("weight"), F.col("room")))
    return marked.join(level, group, "left").withColumn("alloc", F.when(F.col("_ratio").isNull() | (F.abs(F.col("gap")) <= TOLERANCE), 0.0).otherwise(F.signum("gap") * full)).drop("_ratio", "_band", "_level")


def reconcile(model: DataFrame, company: DataFrame, stats: DataFrame, classes: DataFrame, keys: list[str], by: str = "week", max_cut: float = MAX_CUT) -> DataFrame:
    """Adjusts m so that details add up to the company's model, within each key's bounds, per week or per day.

    `model` has (keys, date, m, hf, backlog, has_model), `company` (date, model). Upward room is what the weekday's 95th
    percentile leaves, downward room the share `max_cut` of the total. Weights are the summed weekday variances.
    """
    block = week_start(F.col("date")) if by == "week" else F.col("date")
    rows = model.drop("week", "dow", "mean", "std", "cap").withColumns({"block": block, "dow": (F.dayofweek("date") - 1).cast("bigint")})
    rows = rows.join(stats.select(*keys, "dow", "std", "cap"), [*keys, "dow"], "left").join(classes.select(*keys, "demand_class"), keys, "left")
    totals = rows.groupBy(*keys, "block", "demand_class", "has_model").agg(F.sum("m").alias("total"), F.sum(F.coalesce("std", F.lit(0.0)) * F.coalesce("std", F.lit(0.0))).alias("variance"), F.sum(F.coalesce("cap", F.lit(0.0)) * F.greatest("hf", F.lit(1.0))).alias("capacity"))
    target = company.withColumn("block", block).groupBy("block").agg(F.sum("model").alias("target"))
    gaps = totals.groupBy("block").agg(F.sum("total").alias("detail")).join(target, "block").withColumn("gap", F.col("target") - F.col("detail"))
    each = totals.join(gaps.select("block", "gap"), "block")
    up = F.col("has_model") & F.col("demand_class").isin(REGULAR, INTERMITTENT) & (F.col("variance") > 0)
    up = up & (F.col("total") > 0) if by == "week" else up
    down = F.col("has_model") & F.col("demand_class").isin(REGULAR, INTERMITTENT, NEW) & (F.col("variance") > 0) & (F.col("total") > 0)
    able = F.when(F.col("gap") > 0, up).otherwise(down)
    each = each.withColumns({"weight": F.when(able, F.col("variance")).otherwise(0.0), "room": F.when(~able, 0.0).when(F.col("gap") > 0, F.greatest(F.lit(0.0), F.col("capacity") - F.col("total"))).otherwise(F.col("total") * max_cut)})
    filled = water_fill(each, "block").select(*keys, "block", "total", "gap", "alloc", (F.col("weight") > 0).alias("_eligible"))
    spread = rows.join(filled, [*keys, "block"])
    share = F.when(F.col("total") > 0, F.col("m") / F.col("total")).otherwise(0.0) if by == "week" else F.lit(1.0)
    out = spread.withColumn("adj", F.col("alloc") * share).withColumn("model_final", F.greatest(F.col("m") + F.col("adj"), F.lit(0.0)))
    return out.withColumn("final", F.greatest("model_final", "backlog")).select(*keys, "date", "block", "demand_class", "has_model", "hf", "m", "adj", "model_final", "backlog", "final", "gap", "_eligible")


def summary(reconciled: DataFrame, company: DataFrame) -> DataFrame:
    """Totals by date beside the company's."""
    sums = reconciled.groupBy("date").agg(F.sum("m").alias("before"), F.sum("adj").alias("adjustment"), F.sum("model_final").alias("after"), F.sum("backlog").alias("backlog"), F.sum(F.greatest(F.col("backlog") - F.col("model_final"), F.lit(0.0))).alias("excess"), F.sum("final").alias("detail_total"))
    return sums.join(company, "date").select("date", F.col("model").alias("target"), "before", (F.col("model") - F.col("before")).alias("gap"), F.when(F.col("model") > 1e-6, (F.col("model") - F.col("before")) / F.col("model") * 100).alias("gap_pct"), "adjustment", "after", (F.col("model") - F.col("after")).alias("residual"), "backlog", "excess", "initial", "detail_total", (F.col("detail_total") - F.col("initial")).alias("detail_minus_overall"))


def blocks(reconciled: DataFrame, company: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by week beside the company's, with how many keys could take a share of the gap and how many did."""
    week = week_start(F.col("date")).alias("week")
    excess = F.sum(F.greatest(F.col("backlog") - F.col("model_final"), F.lit(0.0)))
    sums = reconciled.groupBy(week).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.countDistinct("date").alias("days"), F.sum("m").alias("before"), F.sum("adj").alias("adjustment"), F.sum("model_final").alias("after"), F.sum("backlog").alias("backlog"), excess.alias("excess"), F.sum("final").alias("detail_total"))
    each = reconciled.groupBy(week, *keys).agg(F.max("_eligible").alias("_e"), F.max(F.abs("adj")).alias("_a"))
    counts = each.groupBy("week").agg(F.count_if("_e").alias("eligible"), F.count_if(F.col("_a") > 1e-9).alias("adjusted"))
    days = reconciled.select("date").distinct()
    target = company.join(days, "date", "left_semi").groupBy(week).agg(F.sum("model").alias("target"), F.sum("initial").alias("initial"))
    joined = sums.join(target, "week").join(counts, "week").withColumn("gap", F.col("target") - F.col("before"))
    return joined.select("week", "first_day", "last_day", "days", "target", "before", "gap", F.when(F.col("target") > 1e-6, F.col("gap") / F.col("target") * 100).alias("gap_pct"), "adjustment", (F.col("target") - F.col("after")).alias("unresolved"), "eligible", "adjusted", "backlog", "excess", "initial", "detail_total", (F.col("detail_total") - F.col("initial")).alias("detail_minus_overall"))


def reasons(reconciled: DataFrame, keys: list[str]) -> DataFrame:
    """Why a key's forecast is what it is, in one line."""
    sums = reconciled.groupBy(*keys, "demand_class").agg(F.sum("adj").alias("adj"), F.max(F.col("backlog") > F.col("model_final")).alias("over"))
    line = F.array_compact(F.array(
        F.when(F.col("demand_class") == "Dormant", "dormant: backlog only").otherwise(F.concat(F.col("demand_class"), F.lit(" series"))),
        F.when(F.col("adj") > TOLERANCE, "increased to meet the company total").when(F.col("adj") < -TOLERANCE, "decreased to meet the company total").otherwise("no reconciliation needed"),
        F.when(F.col("over"), "backlog exceeds the model"),
    ))
    return sums.select(*keys, F.array_join(line, "; ").alias("reason"))


def daily_reasons(reconciled: DataFrame, keys: list[str], context: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """For each key and day: how backlog and model make the final figure, the adjustment, and why, in words.

    `context` (keys, date, slot, hf, own) tells which holiday shaped a day's model and whether by the key's own history;
    `models` (keys, model) names the models, of fits that failed too.
    """
    whole = lambda c: F.round(F.round(c, 6)).cast("bigint").cast("string")  # noqa: E731; the order of a sum must not decide halves
    rows = reconciled
    if context is not None:
        rows = rows.drop("hf").join(context.select(*keys, "date", "slot", "hf", "own"), [*keys, "date"], "left")
    if models is not None:
        rows = rows.join(models.select(*keys, F.col("model").alias("_model")), keys, "left")
    kind, named = F.concat("demand_class", F.lit(" series")), F.lit("")
    failed = F.lit("no model: backlog only")
    if models is not None:
        named = F.coalesce(F.concat(F.lit(" by "), "_model"), F.lit(""))
        failed = F.when(F.col("_model").isNotNull(), F.concat("_model", F.lit(" fit failed: backlog only"))).otherwise(failed)
    holiday = F.lit(None).cast("string")
    if context is not None:
        shaped = F.col("has_model") & F.col("slot").isNotNull() & (F.abs(F.round(F.col("hf") - 1, 9)) > 0.05)
        holiday = F.when(shaped, F.concat("slot", F.lit(" x"), F.format_number(F.round("hf", 9), 2), F.when(F.col("own"), " (own history)").otherwise(" (borrowed)")))
    model, adj, over = F.col("has_model"), F.col("adj"), F.col("backlog") - F.col("model_final")
    line = F.array_compact(F.array(
        F.when(F.col("demand_class") == "Dormant", "dormant: backlog only").when(~model, failed).otherwise(F.concat(kind, named)),
        holiday,
        F.when(F.col("backlog") > 0, F.concat(F.lit("booked "), whole(F.col("backlog")), F.lit(" lb"))),
        F.when(adj > TOLERANCE, F.concat(F.lit("increased by "), whole(adj), F.lit(" lb"))).when(adj < -TOLERANCE, F.concat(F.lit("decreased by "), whole(-adj), F.lit(" lb"))),
        F.when(model & (over > TOLERANCE), F.concat(F.lit("backlog exceeds the model by "), whole(over), F.lit(" lb"))),
        F.when(F.abs(adj) <= TOLERANCE, "no reconciliation needed"),
    ))
    parts = F.concat(whole(F.col("backlog")), F.lit(" + "), whole(F.col("final") - F.col("backlog")), F.lit(" = "), whole(F.col("final")))
    return rows.select(*keys, "date", parts.alias("parts"), F.round(F.round("adj", 6), 1).alias("adj"), F.round(F.round("final", 6), 1).alias("final"), F.array_join(line, "; ").alias("reason"))
