"""Fitted models over a panel of series: forecasts, backtests and forecasts by class, with failures as status rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arima, ets, fits
from .classify import MODELS as CLASS_MODELS
from .forecasts import window_count

Outcome = tuple[np.ndarray, np.ndarray] | str
# Many series at once: (values, days, horizon, event days) -> of each its forecasts and their deviation, or why there are none.
Fit = Callable[[list[np.ndarray], list[np.ndarray], int, np.ndarray], list[Outcome]]


def _each(fit: Callable[[np.ndarray, np.ndarray, int, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Fit:
    """A fit of one series as one of many; a failed fit is a result."""

    def one(y, days, horizon, events) -> Outcome:
        try:
            return fit(y, days, horizon, events)
        except Exception as error:
            return str(error)

    return lambda values, days, horizon, events: [one(y, d, horizon, events) for y, d in zip(values, days, strict=True)]


def _together(fit: Callable[[list[np.ndarray], int], list], least: int) -> Fit:
    """A fit that takes series side by side; where it fails on all of them, each is fitted by itself."""

    def many(values, days, horizon, events) -> list[Outcome]:
        try:
            return [f"needs {least} observations" if f is None else (f.point, f.spread) for f in fit(values, horizon)]
        except Exception as error:
            return [str(error)] if len(values) == 1 else [many([y], days, horizon, events)[0] for y in values]

    return many


def _pretrained(y, days, horizon, events):
    raise ValueError("pretrained weights are not available")


REGISTRY: dict[str, Fit] = {
    "Seasonal Naive": _each(lambda y, days, horizon, events: fits.seasonal_naive(y, horizon)),
    "AutoARIMA": _together(arima.fit_many, arima.LEAST),
    "AutoARIMA (thorough)": _together(lambda values, horizon: arima.fit_many(values, horizon, arima.WIDE), arima.LEAST),
    "AutoETS": _together(ets.fit_many, ets.LEAST),
    "HistGradientBoosting": _each(lambda y, days, horizon, events: (fits.boosting(y, days, horizon, events), np.full(horizon, np.nan))),
    "Chronos-2": _each(_pretrained),
}
NAMES = ["AutoETS", "AutoARIMA", "HistGradientBoosting", "Chronos-2"]
BATCH = ["Seasonal Naive", "AutoARIMA", "AutoETS", "HistGradientBoosting"]
MAX_FAILED = 0.2
LEAST_FINAL = 21  # days of history that a stored forecast needs
TOGETHER = 128  # series that are fitted side by side at most


def packed(series: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key with its days and values in order: the unit that fits take."""
    return series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "y"))).alias("_v")).select(*keys, F.col("_v.date").alias("days"), F.col("_v.y").alias("values"))


def _key_types(frame: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys)


def outcomes(name: str, values: list[np.ndarray], days: list[np.ndarray], horizon: int, events: np.ndarray, least: int = 0) -> list[Outcome]:
    """Each series' forecasts by the model, or why there are none; a series of fewer than `least` days is not fitted."""
    out: list[Outcome] = [f"needs {least} observations" if len(y) < least else "" for y in values]
    use = [i for i, y in enumerate(values) if len(y) >= least]
    for k in range(0, len(use), TOGETHER):
        some = use[k : k + TOGETHER]
        for i, found in zip(some, REGISTRY[name]([values[i] for i in some], [days[i] for i in some], horizon, events), strict=True):
            bad = not isinstance(found, str) and (len(found[0]) < horizon or not np.isfinite(found[0]).all())
            out[i] = "forecast is not finite" if bad else found
    return out


def _dealt(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs over all cores: their number is given, as otherwise small rows of long work are gathered in few tasks."""
    spark = jobs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return jobs.repartition(tasks, *(F.col(c) for c in [*keys, "model"]))


def _jobs(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray], dict[str, list[int]]]:
    """Values and days of a batch's rows, and the rows of each model."""
    days = [np.array(d, "datetime64[D]") for d in batch.column("days").to_pylist()]
    values = [np.array(v, float) for v in batch.column("values").to_pylist()]
    rows: dict[str, list[int]] = {}
    for i, name in enumerate(batch.column("model").to_pylist()):
        rows.setdefault(name, []).append(i)
    return values, days, rows


def _fitted(jobs: DataFrame, keys: list[str], horizon: int, events: list[str], clip: bool, least: int = 0) -> DataFrame:
    """A row for each day ahead of each job (keys, model, days, values), or one row with a status."""
    known = np.array(events, "datetime64[D]")
    names = [*keys, "model", "date", "yhat", "lower", "upper", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, days, rows = _jobs(batch)
            row, date, table, status = [], [], [], []
            for name, mine in rows.items():
                width = fits.Z_NAIVE if name == "Seasonal Naive" else fits.Z80
                for i, found in zip(mine, outcomes(name, [values[i] for i in mine], [days[i] for i in mine], horizon, known, least), strict=True):
                    if isinstance(found, str):
                        row.append([i])
                        date.append(np.full(1, np.datetime64("NaT"), "datetime64[D]"))
                        table.append(np.full((3, 1), np.nan))
                        status.append(f"skipped: {found}")
                        continue
                    point, spread = found
                    lower, upper = point - width * spread, point + width * spread
                    row.append([i] * horizon)
                    date.append(days[i][-1] + np.arange(1, horizon + 1))
                    table.append(np.stack([np.maximum(point, 0), np.maximum(lower, 0), upper]) if clip else np.stack([point, lower, upper]))
                    status += ["ok"] * horizon
            if row:
                at, numbers = pa.array(np.concatenate(row)), np.concatenate(table, axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in [*keys, "model"]), pa.array(np.concatenate(date)), *(pa.array(x, from_pandas=True) for x in numbers), pa.array(status, pa.string())], names=names)

    schema = f"{_key_types(jobs, keys)}, model string, date date, yhat double, lower double, upper double, status string"
    return _dealt(jobs.select(*keys, "model", "days", "values"), keys).mapInArrow(run, schema)


def fit_panel(series: DataFrame, keys: list[str], horizon: int, models: list[str] | None = None, events: list[str] = (), least: int = 0) -> DataFrame:
    """(keys, model, date, yhat, lower, upper, status) for each key and model, fitted on the whole series.

    A failed or skipped model gives one row without a date whose status says why, and so does a key with fewer than
    `least` days. The pretrained model has no weights here and is always skipped.
    """
    each = F.explode(F.array(*(F.lit(m) for m in models or NAMES))).alias("model")
    return _fitted(packed(series, keys).select(*keys, "days", "values", each), keys, horizon, list(events), True, least)


def smoothed(series: DataFrame, keys: list[str], form: str, parameters: tuple[float, float, float, float]) -> DataFrame:
    """(keys, level, slope, season, deviation): the last states of exponential smoothing with fixed parameters.

    `form` is one of `ets.FORMS` by name; keys with less than a season are absent.
    """
    kind = next(f for f in ets.FORMS if f.name == form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.array(v, float) for v in batch.column("values").to_pylist()]
            if values:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(x) for x in ets.last_states(values, kind, parameters))], names=[*keys, "level", "slope", "season", "deviation"])

    jobs = packed(series, keys).where(F.size("values") >= ets.SEASON).select(*keys, "values")
    return jobs.mapInArrow(run, f"{_key_types(jobs, keys)}, level double, slope double, season double, deviation double")


def fit_by_class(series: DataFrame, classes: DataFrame, keys: list[str], horizon: int, thorough: bool = False) -> DataFrame:
    """`fit_panel` with one model a key, by its demand class; keys of a class without a model, or too short for it, are absent."""
    model: Column = F.lit(None).cast("string")
    for kind, name in CLASS_MODELS.items():
        if name:
            model = F.when(F.col("demand_class") == kind, f"{name} (thorough)" if thorough and name == "AutoARIMA" else name).otherwise(model)
    jobs = packed(series, keys).join(classes.select(*keys, "demand_class"), keys).withColumn("model", model).where("model is not null").drop("demand_class")
    return _fitted(jobs, keys, horizon, [], clip=True)


def backtest_panel(series: DataFrame, keys: list[str], horizon: int, models: list[str] | None = None, events: list[str] = ()) -> DataFrame:
    """(keys, model, window, date, y, yhat, error, seconds) of each model over all rolling origins.

    A key and model is one row with one copy of the history; its windows are cut in the task and fitted side by side. A
    failed window has one row without a day; its error says why. Forecasts are not clipped here. `seconds` is a window's
    share of the time that its model took.
    """
    known, names = np.array(list(events), "datetime64[D]"), models or BATCH
    jobs = packed(series, keys).withColumn("windows", window_count(F.size("values"), horizon)).where("windows > 0")
    jobs = jobs.select(*keys, "days", "values", "windows", F.explode(F.array(*(F.lit(m) for m in names))).alias("model"))
    columns = [*keys, "model", "window", "date", "y", "yhat", "error", "seconds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, days, rows = _jobs(batch)
            windows = batch.column("windows").to_pylist()
            row, window, date, y, yhat, error, seconds = ([] for _ in range(7))
            for name, mine in rows.items():
                cuts = [(i, w, len(values[i]) - (windows[i] - w + 1) * horizon) for i in mine for w in range(1, windows[i] + 1)]
                began = time.perf_counter()
                found = outcomes(name, [values[i][:n] for i, _, n in cuts], [days[i][:n] for i, _, n in cuts], horizon, known)
                took = (time.perf_counter() - began) / max(1, len(cuts))
                for (i, w, n), one in zip(cuts, found, strict=True):
                    failed = isinstance(one, str)
                    many = 1 if failed else horizon
                    row += [i] * many
                    window += [w] * many
                    date.append(np.full(1, np.datetime64("NaT"), "datetime64[D]") if failed else days[i][n : n + horizon])
                    y.append(np.full(1, np.nan) if failed else values[i][n : n + horizon])
                    yhat.append(np.full(1, np.nan) if failed else one[0])
                    error += [one if failed else None] * many
                    seconds += [took] * many
            if row:
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in [*keys, "model"]), pa.array(window, pa.int64()), pa.array(np.concatenate(date)), pa.array(np.concatenate(y), from_pandas=True), pa.array(np.concatenate(yhat), from_pandas=True), pa.array(error, pa.string()), pa.array(seconds)], names=columns)

    schema = f"{_key_types(jobs, keys)}, model string, window bigint, date date, y double, yhat double, error string, seconds double"
    return _dealt(jobs, keys).mapInArrow(run, schema)


def roll_up(tests: DataFrame, measures: DataFrame, keys: list[str], names: list[str], segments: DataFrame) -> DataFrame:
    """One row for each segment and model: measures over its successful windows, window counts, whether it is skipped and why.

    `measures` are `forecasts.metrics` of the successful rows. A model is skipped without a successful window, or if more
    than `MAX_FAILED` of its windows failed; in that case its measures stay.
    """
    windows = tests.groupBy(*keys, "model", "window").agg(F.max("error").alias("error"), F.first("seconds").alias("seconds"))
    counted = windows.groupBy(*keys, "model").agg(F.count_if(F.col("error").isNull()).alias("n_success_windows"), F.count_if(F.col("error").isNotNull()).alias("n_failed_windows"), F.min(F.when(F.col("error").isNotNull(), F.struct("window", "error")))["error"].alias("_error"), F.sum("seconds").alias("runtime_seconds"))
    every = segments.select(*keys).distinct().select(*keys, F.explode(F.array(*(F.lit(n) for n in names))).alias("model"))
    joined = every.join(counted, [*keys, "model"], "left").join(measures.drop("n_windows"), [*keys, "model"], "left").fillna(0, ["n_success_windows", "n_failed_windows"])
    failed, total = F.col("n_failed_windows"), F.col("n_failed_windows") + F.col("n_success_windows")
    reason = (
        F.when(total == 0, "not enough history for the horizon")
        .when(F.col("n_success_windows") == 0, F.concat(F.lit("every window failed: "), "_error"))
        .when(failed > MAX_FAILED * total, F.concat(failed.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" windows failed")))
    )
    return joined.withColumns({"skip_reason": reason, "skipped": reason.isNotNull()}).drop("_error")
