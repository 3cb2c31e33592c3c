"""Order exports to clean order lines: sheets in, one de-duplicated frame and its data-quality report out.

Sheets are DataFrames by name, from a workbook (small, read on the driver) or from files that Spark reads itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cleaning as c
from ..operators import ingest
from . import xlsx


@dataclass
class Orders:
    """`rows` are valid lines (sheet, date, net_pounds, ids and all columns of the export), `report` counts by sheet,
    `duplicates` is one row of counts, `ignored` lists sheets that are no half-year sheets, `skipped` those without a
    required column."""

    rows: DataFrame
    report: DataFrame
    duplicates: DataFrame
    ignored: list[str]
    skipped: list[str]


def half_years(names: list[str]) -> tuple[list[str], list[str]]:
    """Half-year sheets in order of time, and the others."""
    key = {n: c.half_year_of(n) for n in names}
    return sorted((n for n in names if key[n]), key=lambda n: key[n]), [n for n in names if not key[n]]


def load_orders(sheets: dict[str, DataFrame], ids: dict[str, list[str]], required: tuple[str, ...] = (), deduplicate: bool = True) -> Orders:
    """Clean, combine and de-duplicate the half-year sheets.

    `ids` names the id columns to resolve by their headers. Of rows that agree in all columns the one of the earliest
    sheet stays. A material without a name gets its number as name; a plant column without any value goes.
    """
    kept, ignored = half_years(list(sheets))
    if not kept:
        raise ValueError(f"no half-year sheet such as 24HY1 among {list(sheets)}")
    found = {name: c.standardise(sheets[name], name, ids) for name in kept}
    good = [df.withColumn("_order", F.lit(k)) for k, df in enumerate(found.values()) if df is not None]
    if not good:
        raise ValueError("no sheet has a date and a pounds column")
    both = ingest.union_sheets(good)
    valid = ingest.valid_rows(both)
    if valid.isEmpty():
        raise ValueError("no valid rows")
    missing = [x for x in required if x not in valid.columns]
    if missing:
        raise ValueError(f"no column is known as {', '.join(missing)}")
    outside = ("sheet", "_order")
    rows = ingest.drop_exact_duplicates(valid, outside, ("_order",)) if deduplicate else valid
    rows = rows.drop("_order")
    if "plant" in rows.columns and rows.where(F.col("plant").isNotNull()).isEmpty():
        rows = rows.drop("plant")
    if "material_no" in rows.columns and "material_name" not in rows.columns:
        rows = rows.withColumn("material_name", F.col("material_no"))
    return Orders(rows, ingest.quality_report(both), ingest.count_exact_duplicates(valid, outside), ignored, [n for n, df in found.items() if df is None])


def load_workbook(spark: SparkSession, path: str, reconciled: bool = False, deduplicate: bool = True) -> Orders:
    """The orders of an .xlsx export, with the ids of the batch family (customer, material group) or of the reconciled
    one (customer, material name and number, plant)."""
    ids = c.RECONCILED_IDS if reconciled else c.SEGMENT_IDS
    required = ("customer", "material_no") if reconciled else ("customer", "material_group")
    return load_orders(xlsx.sheet_frames(spark, path), ids, required, deduplicate)


def csv_sheets(spark: SparkSession, folders: dict[str, str]) -> dict[str, DataFrame]:
    """Sheets that were exported as CSV files with headers, by name; all columns are texts."""
    return {name: spark.read.csv(path, header=True) for name, path in folders.items()}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(date, uplift_pct) of an event CSV; rows without a readable date are left out, unreadable percentages are null."""
    return event_rows(spark.read.csv(path, header=True))


def event_rows(table: DataFrame) -> DataFrame:
    """`read_events` over texts that were read already; no date column gives no rows."""
    day, share = (c.find_column(table.columns, known, last=True) for known in (c.EVENT_DATE_HEADERS, c.EVENT_UPLIFT_HEADERS))
    if day is None:
        return table.sparkSession.createDataFrame([], "date date, uplift_pct double")
    percent = F.col(f"`{share}`").cast("string").try_cast("double") if share else F.lit(None).cast("double")
    return table.select(c.parse_day(F.col(f"`{day}`")).alias("date"), percent.alias("uplift_pct")).where("date is not null")
