"""Holiday weeks, and holiday factors shrunk from company to material to combination."""

from __future__ import annotations

import calendar as months
import datetime as dt
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

CENTRED, CENTRED_LEAST = 91, 28
PASSES, FULL_EVIDENCE_DAYS, LOW, HIGH, PADDING = 3, 3, 0.3, 3.0, 60
K_COMPANY, K_MATERIAL, K_COMBO = 0.5, 1.5, 4.0
_MONTHS = months.Calendar()


def easter(year: int) -> dt.date:
    """Gregorian Easter by the anonymous computus."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return dt.date(year, month, day + 1)


def weekdays(year: int, month: int, weekday: int) -> list[dt.date]:
    """The month's days of one weekday (0 is Monday), in order."""
    return [week[weekday] for week in _MONTHS.monthdatescalendar(year, month) if week[weekday].month == month]


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    return weekdays(year, month, weekday)[n - 1]


def last_weekday(year: int, month: int, weekday: int) -> dt.date:
    return weekdays(year, month, weekday)[-1]


# Name, date, weeks before, weeks after.
HOLIDAYS: list[tuple[str, Callable[[int], dt.date], int, int]] = [
    ("Thanksgiving", lambda y: nth_weekday(y, 11, 3, 4), 4, 1),
    ("Christmas", lambda y: dt.date(y, 12, 25), 2, 0),
    ("New Year", lambda y: dt.date(y, 1, 1), 0, 1),
    ("Super Bowl", lambda y: nth_weekday(y, 2, 6, 2), 3, 1),
    ("Easter", easter, 3, 1),
    ("Memorial Day", lambda y: last_weekday(y, 5, 0), 2, 1),
    ("July 4th", lambda y: dt.date(y, 7, 4), 2, 1),
    ("Labor Day", lambda y: nth_weekday(y, 9, 0, 1), 2, 1),
]


def holiday_dates(first_year: int, last_year: int) -> list[tuple[int, int, str, dt.date, int, int]]:
    """(year, order, name, date, weeks before, weeks after)."""
    return [(y, k, name, rule(y), before, after) for y in range(first_year, last_year + 1) for k, (name, rule, before, after) in enumerate(HOLIDAYS)]


def slot_name(holiday, week):
    return F.concat(holiday, F.when(week == 0, " wk0").when(week > 0, F.concat(F.lit(" wk+"), week.cast("string"))).otherwise(F.concat(F.lit(" wk"), week.cast("string"))))


def calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """(date, slot, holiday, week, year, block, block_first, block_last, block_days); a day goes to the nearest holiday.

    Its size is that of the calendar, not of the data.
    """
    dates = spark.createDataFrame(holiday_dates(start.year - 1, end.year + 1), "year int, ord int, holiday string, day date, before int, after int")
    weeks = dates.withColumn("week", F.explode(F.expr("sequence(-before, after)")))
    days = weeks.withColumn("date", F.explode(F.expr("sequence(date_add(date_sub(day, dayofweek(day) - 1), 7 * week), date_add(date_sub(day, dayofweek(day) - 1), 7 * week + 6))")))
    days = days.where(F.col("date").between(F.lit(start), F.lit(end))).withColumn("dist", F.abs(F.datediff("date", "day")))
    nearest = Window.partitionBy("date").orderBy("dist", "year", "ord", "week")
    one = days.withColumn("_r", F.row_number().over(nearest)).where("_r = 1").withColumn("slot", slot_name(F.col("holiday"), F.col("week"))).withColumn("block", F.concat_ws("|", "holiday", "year", "week"))
    block = Window.partitionBy("block")
    return one.select("date", "slot", "holiday", F.col("week").cast("bigint").alias("week"), F.col("year").cast("bigint").alias("year"), "block", F.min("date").over(block).alias("block_first"), F.max("date").over(block).alias("block_last"), F.count(F.lit(1)).over(block).alias("block_days"))


def _fit_slots(days: np.ndarray, y: np.ndarray, parent: np.ndarray, calendar: dict[str, np.ndarray], k: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots with evidence, their factors and their observations, of one series in the order of its days."""
    at = np.minimum(np.searchsorted(calendar["day"], days), len(calendar["day"]) - 1)
    row = np.flatnonzero(calendar["day"][at] == days)
    slot, block = calendar["slot"][at[row]], calendar["block"][at[row]]
    whole = (calendar["block_first"] >= days[0]) & (calendar["block_last"] <= days[-1])
    low, high = np.maximum(np.arange(len(y)) - CENTRED // 2, 0), np.minimum(np.arange(len(y)) + CENTRED // 2 + 1, len(y))
    blocks, slots = len(calendar["block_days"]), len(parent)
    factor, has = parent, np.zeros(slots, bool)
    counted = np.zeros(slots)
    for _ in range(PASSES):
        freed = y.copy()
        freed[row] /= factor[slot]
        sums = np.append(0.0, np.cumsum(freed))
        base = np.where(high - low >= CENTRED_LEAST, (sums[high] - sums[low]) / (high - low), 0.0)[row]
        used = whole[block] & (base > 0)
        total = lambda value: np.bincount(block[used], value[used], blocks)  # noqa: B023, E731
        demand, expected, sold, seen = total(y[row]), total(base), total((y[row] > 0).astype(float)), total(np.ones(len(row)))
        good = (seen == calendar["block_days"]) & (expected > 0)
        of = calendar["block_slot"][good]
        has = np.bincount(of, minlength=slots) > 0
        counted = np.bincount(of, np.minimum(1.0, sold[good] / FULL_EVIDENCE_DAYS), slots)
        ratio = np.bincount(of, demand[good], slots)[has] / np.bincount(of, expected[good], slots)[has]
        trust = counted[has] / (counted[has] + k)
        factor = parent.copy()
        factor[has] = np.clip(trust * ratio + (1 - trust) * parent[has], LOW, HIGH)
    return np.flatnonzero(has), factor[has], counted[has]


def estimate(series: DataFrame, keys: list[str], days: DataFrame, k: float, parents: list[tuple[DataFrame, list[str]]] = ()) -> DataFrame:
    """(keys, slot, factor, n_obs) of the slots that have evidence; a slot without it has its parent's factor.

    `parents` are profiles with the keys that they are joined on, the nearest first; a slot's parent is the first that
    has evidence for it, and 1 without any.

    Three times the series is freed of the present factors, its centred 91-day mean is taken as a baseline, and a slot's
    ratio of demand to baseline, over whole blocks inside the series, is shrunk to the parent's factor.

    The series is dealt by its keys once, each packed into a row; its parents' factors are joined to that row, and all
    passes run over its arrays, the centred mean by prefix sums. The calendar and a profile without keys, of a row a slot,
    go to the tasks with the code.
    """
    spark = series.sparkSession
    history = series.where(~F.col("is_backlog")) if "is_backlog" in series.columns else series
    known = days.toPandas().sort_values("date")  # the calendar
    slots, slot = np.unique(known["slot"].to_numpy(str), return_inverse=True)
    names, first, block = np.unique(known["block"].to_numpy(str), return_index=True, return_inverse=True)
    number = lambda c: known[c].to_numpy("datetime64[D]").astype(np.int64)
    calendar = {"day": number("date"), "slot": slot, "block": block, "block_slot": slot[first], "block_first": number("block_first")[first], "block_last": number("block_last")[first], "block_days": known["block_days"].to_numpy()[first]}
    place = {name: i for i, name in enumerate(slots)}
    packed = history.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.unix_date("date").alias("day"), F.col("y").cast("double").alias("y")))).alias("_v")).select(*keys, F.col("_v.day").alias("_days"), F.col("_v.y").alias("_y"))
    shared, joined = [], []  # factors by slot, the nearest level first
    for level, (profile, on) in enumerate(parents):
        if on:
            own = profile.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("slot", "factor"))).alias(f"_level{level}"))
            packed = packed.join(own, on, "left")
            joined.append(level)
        shared.append({} if on else {r["slot"]: r["factor"] for r in profile.select("slot", "factor").collect()})  # a row a slot

    def run(batches):
        for batch in batches:
            got = batch.to_pydict()
            found, out = [], []
            for i in range(batch.num_rows):
                parent = np.ones(len(slots))
                for level in reversed(range(len(shared))):
                    held = got[f"_level{level}"][i] or () if level in joined else shared[level].items()
                    for name, value in held:
                        if name in place:
                            parent[place[name]] = value
                which, factor, counted = _fit_slots(np.array(got["_days"][i]), np.array(got["_y"][i]), parent, calendar, k)
                found.append(np.full(len(which), i))
                out.append((which, factor, counted))
            if out and len(calendar["day"]):
                which, factor, counted = (np.concatenate(x) for x in zip(*out, strict=True))
                row = pa.array(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([*(batch.column(key).take(row) for key in keys), pa.array(slots[which].tolist(), pa.string()), pa.array(factor), pa.array(counted)], names=[*keys, "slot", "factor", "n_obs"])

    schema = ", ".join([*(f"`{key}` {series.schema[key].dataType.simpleString()}" for key in keys), "slot string", "factor double", "n_obs double"])
    if not len(known):
        return spark.createDataFrame([], schema)
    return packed.mapInArrow(run, schema)


def with_factor(rows: DataFrame, days: DataFrame | None, levels: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Adds each day's `factor`: that of the first level with evidence for the day's slot, 1 where none has or off holidays.

    `levels` are profiles with the keys they are joined on, the finest first. A profile without keys has one row a slot,
    so its size is that of the calendar. Without `days`, rows have their slot already and keep it.
    """
    out = rows if days is None else rows.join(F.broadcast(days.select("date", "slot")), "date", "left")
    for k, (profile, keys) in enumerate(levels):
        known = profile.select(*keys, "slot", F.col("factor").alias(f"_factor{k}"))
        out = out.join(known if keys else F.broadcast(known), [*keys, "slot"], "left")
    found = F.coalesce(*(F.col(f"_factor{k}") for k in range(len(levels))), F.lit(1.0))
    return out.withColumn("factor", F.when(F.col("slot").isNull(), 1.0).otherwise(found)).drop(*(["slot"] if days is not None else []), *(f"_factor{k}" for k in range(len(levels))))


def summary_text(profile: DataFrame, keys: list[str], every: DataFrame | None = None, top: int = 6, least: float = 0.10) -> DataFrame:
    """(keys, holidays): the strongest factors of each key as text, with whether they rest on its own evidence.

    `every` lists the keys, with `has_model`; a key without a model is "n/a (no model)", one without a factor `least`
    off 1 has no material effect. Without `every`, the keys are the profile's.
    """
    off = F.round(F.abs(F.col("factor") - 1), 9)
    rank = Window.partitionBy(*keys).orderBy(off.desc(), "slot")
    named = profile.where(off >= least).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= top)
    text = F.concat("slot", F.lit(" x"), F.format_number(F.round("factor", 9), 2), F.when(F.col("n_obs") >= 1, " (own)").otherwise(" (borrowed)"))
    strong = named.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", text.alias("t")))), lambda s: s["t"]), "; ").alias("_text"))
    known = profile.select(*keys, F.lit(True).alias("has_model")).distinct() if every is None else every.select(*keys, "has_model")
    none = F.when(~F.col("has_model"), "n/a (no model)").otherwise(F.coalesce("_text", F.lit("No material holiday effects (all within +/-10%)")))
    return known.join(strong, keys, "left").select(*keys, none.alias("holidays"))
