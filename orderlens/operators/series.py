"""Daily series in long form: group sums, dense calendars, gap treatment, the as-of split."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F


def daily_sum(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by key and day; rows with a null key are left out."""
    lines = lines.dropna(subset=keys) if keys else lines
    return lines.groupBy(*keys, "date").agg(F.sum("net_pounds").alias("y"))


def daily_with_overall(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Daily sums of every segment and of all together, in one aggregation; `overall` marks the total's rows.

    Rows with a null key are in the total only.
    """
    both = lines.groupingSets([[F.col("date")], [*(F.col(k) for k in keys), F.col("date")]], *keys, "date").agg(F.sum("net_pounds").alias("y"), F.grouping(keys[0]).cast("bigint").alias("overall"))
    for key in keys:
        both = both.where((F.col("overall") == 1) | F.col(key).isNotNull())
    return both.select(*(F.when(F.col("overall") == 1, "__OVERALL__").otherwise(F.col(k)).alias(k) for k in keys), "date", "y", "overall")


def filtered(lines: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows of the wanted values; None stands for all."""
    for column, value in wanted.items():
        lines = lines if value is None else lines.where(F.col(column) == value)
    return lines


def dense(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Every day from a key's first to its last, null where it has no row. Days are made after the aggregation."""
    span = daily.groupBy(*keys).agg(F.min("date").alias("_low"), F.max("date").alias("_high"))
    days = span.select(*keys, F.explode(F.sequence("_low", "_high")).alias("date"))
    return days.join(daily, [*keys, "date"], "left")


def fill_gaps(series: DataFrame, keys: list[str], treatment: str) -> DataFrame:
    """keep: drop missing days; zero: count them as 0; linear: interpolate, ends taking the nearest value."""
    if treatment == "keep":
        return series.where("y is not null")
    if treatment == "zero":
        return series.withColumn("y", F.coalesce("y", F.lit(0.0)))
    if treatment != "linear":
        raise ValueError(f"unknown treatment {treatment!r}")
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    # Both frames grow from their start, so each is one pass; a frame that runs to the end would be read anew for every row.
    past, ahead = (by.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("date"), F.col("date").desc()))
    day = F.when(F.col("y").isNotNull(), F.col("date"))
    marked = series.withColumns({"_y0": F.last("y", True).over(past), "_d0": F.last(day, True).over(past), "_y1": F.last("y", True).over(ahead), "_d1": F.last(day, True).over(ahead)})
    between = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * F.datediff("date", "_d0") / F.datediff("_d1", "_d0")
    return marked.withColumn("y", F.coalesce("y", F.when(F.col("_y0").isNotNull() & F.col("_y1").isNotNull(), between), "_y0", "_y1")).drop("_y0", "_y1", "_d0", "_d1")


def split_as_of(series: DataFrame, as_of: str) -> DataFrame:
    return series.withColumn("is_backlog", F.col("date") > F.lit(as_of).cast("date"))


def modelling_series(lines: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """`modelled` over order lines."""
    return modelled(daily_sum(lines, keys), keys, as_of)


def modelled(daily: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """History up to the as-of day, dense and interpolated, with its position `i` from 1 and its length `n`."""
    return numbered(fill_gaps(_history(daily, keys, F.lit(as_of).cast("date")), keys, "linear"), keys)


def numbered(series: DataFrame, keys: list[str]) -> DataFrame:
    """Adds each day's position `i` from 1 and the series' length `n`."""
    by = Window.partitionBy(*keys)
    return series.withColumns({"i": F.row_number().over(by.orderBy("date")).cast("bigint"), "n": F.count(F.lit(1)).over(by)})


def _history(daily: DataFrame, keys: list[str], day: Column) -> DataFrame:
    started = daily.groupBy(*keys).agg(F.min("date").alias("_low"), F.least(F.max("date"), day).alias("_high")).where("_low <= _high")
    days = started.select(*keys, F.explode(F.sequence("_low", "_high")).alias("date"))
    return days.join(daily, [*keys, "date"], "left")


def zero_filled(daily: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """The reconciled family's series: missing days are zero demand, and every series reaches the as-of day.

    A key whose first order is after the as-of day has no rows.
    """
    day = F.lit(as_of).cast("date")
    spans = daily.groupBy(*keys).agg(F.min("date").alias("_low"), F.greatest(F.max("date"), day).alias("_high")).where(F.col("_low") <= day)
    days = spans.select(*keys, F.explode(F.sequence("_low", "_high")).alias("date"))
    return split_as_of(days.join(daily, [*keys, "date"], "left").withColumn("y", F.coalesce("y", F.lit(0.0))), as_of)


def next_sunday(day: Column) -> Column:
    """The day itself if it is a Sunday, else the next one."""
    return F.next_day(F.date_sub(day, 1), "SU")


def week_start(day: Column) -> Column:
    """The Sunday that begins the day's week."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_end(day: Column) -> Column:
    return F.date_add(week_start(day), 6)


def forecast_start(as_of: dt.date, align_to_sunday: bool = False) -> dt.date:
    """The first day of a forecast: the day after the as-of day, or the Sunday on or after it."""
    tomorrow = as_of + dt.timedelta(1)
    return tomorrow + dt.timedelta((6 - tomorrow.weekday()) % 7) if align_to_sunday else tomorrow


def segments(lines: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """(keys, place): the overall row first, then the keys in order, at most `limit` of them; keys with nulls are left out."""
    present = lines.select(*keys).dropna().distinct()
    some = present.orderBy(*keys).limit(limit) if limit is not None else present
    place = F.row_number().over(Window.orderBy(*keys)).cast("bigint")  # one row a segment
    overall = lines.sparkSession.range(1).select(*(F.lit("__OVERALL__").alias(k) for k in keys), F.col("id").alias("place"))
    return overall.unionByName(some.withColumn("place", place))


def first_names(lines: DataFrame) -> DataFrame:
    """(material_no, material_name): each material's first name that is not null, by date, then by name."""
    known = lines.where("material_no is not null and material_name is not null")
    return known.groupBy("material_no").agg(F.min_by("material_name", F.struct("date", "material_name")).alias("material_name"))


def with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds `material_name`, the number where a material has no name."""
    return rows.join(names, "material_no", "left").withColumn("material_name", F.coalesce("material_name", F.col("material_no")))
