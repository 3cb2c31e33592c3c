"""Tolerant cleaning of order exports, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Headers and words of order exports.
DATE_HEADERS = ["matavaildt"]
MEASURE_HEADERS = ["netpounds"]
BLANK_WORDS = ["", "nan", "none", "n/a", "na", "-"]
HALF_YEAR = r"^(\d{2})hy?([12])$"
SEGMENT_IDS = {
    "customer": ["customer", "cg3", "customer group 3", "customergroup3", "cust group 3", "customer group", "sold to party", "soldtoparty", "sold to", "customer name"],
    "material_group": ["material group", "materialgroup", "matl group", "mat group", "material grp", "matgroup", "product group", "productgroup", "material category"],
}
RECONCILED_IDS = {"customer": ["Customer Name"], "material_name": ["ReMat Name"], "material_no": ["ReMat No"], "plant": ["Plant", "Ship Pt"]}
EVENT_DATE_HEADERS = ["date", "highproductiondate"]
EVENT_UPLIFT_HEADERS = ["upliftpercent", "uplift", "upliftpct"]

# Day texts are read in the first of these forms that fits; texts of digits alone are days only as yyyyMMdd. Beside each form
# stands a shape that all of its texts of four-digit years have: a text that a form can't read costs an exception, one of
# another shape does not.
DAY_FORMS = {
    "yyyy-M-d": r"^[0-9]{4}-[-+0-9]+$",
    "M/d/yyyy": r"^[-+0-9]+/[-+0-9]+/[0-9]{4}$",
    "M/d/yy": r"^[-+0-9]+/[-+0-9]+/[0-9]{2}$",
    "yyyy/M/d": r"^[0-9]{4}/[-+0-9]+/[-+0-9]+$",
    "d-MMM-yyyy": r"^[-+0-9]+-[^0-9]+-[0-9]{4}$",
    "d-MMM-yy": r"^[-+0-9]+-[^0-9]+-[0-9]{2}$",
    "d MMM yyyy": r"^[-+0-9]+ [^0-9]+ [0-9]{4}$",
    "MMM d, yyyy": r"^[^0-9]+ [-+0-9]+, [0-9]{4}$",
    "MMM d yyyy": r"^[^0-9]+ [-+0-9]+ [0-9]{4}$",
    "M-d-yyyy": r"^[-+0-9]+-[0-9]{4}$",
    "d.M.yyyy": r"^[-+0-9]+\.[-+0-9]+\.[0-9]{4}$",
    "yyyyMMdd": r"^[0-9]{8}$",
}
YEARS = (1900, 2200)


def header_token(name) -> str:
    """Lower case, letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", str(name).strip().lower())


def find_column(columns: list[str], headers: list[str], last: bool = False) -> str | None:
    """The first (or last) column that has one of the given headers, by their tokens."""
    known = {header_token(h) for h in headers}
    return next((c for c in (reversed(columns) if last else columns) if header_token(c) in known), None)


def half_year_of(sheet: str) -> tuple[int, int] | None:
    """(year, half) of a half-year sheet's name."""
    found = re.match(HALF_YEAR, header_token(sheet))
    return (int(found[1]), int(found[2])) if found else None


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def token(column: Column) -> Column:
    """`header_token` over a column."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def is_half_year(sheet: Column) -> Column:
    return token(sheet).rlike(HALF_YEAR)


def half_year_key(sheet: Column) -> Column:
    """(year, half) of a half-year sheet, (99, 9) for others, so that sheets sort in time."""
    normal = token(sheet)

    def part(k: int, other: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(normal, HALF_YEAR, k), F.lit("")).cast("int"), F.lit(other))

    return F.struct(part(1, 99).alias("year"), part(2, 9).alias("half"))


def _is_number(raw: Column) -> Column:
    """Whether the column's type is numeric; known when the plan is made."""
    return F.typeof(raw).rlike(r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$")


def _as_double(raw: Column) -> Column:
    """The value of a numeric column; its own text reads back exactly. Not-a-number counts as missing."""
    number = raw.cast("string").try_cast("double")
    return F.when(~F.isnan(number), number)


def _bound(value: Column, use) -> Column:
    """`use` over a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_number(raw: Column) -> Column:
    """struct(value, reason): a number read from text, or why there is none (missing, blank, unparseable).

    Parentheses negate; separators, units and other characters are dropped; a second point or sign rejects. A value that
    cannot be read is never taken as zero. Columns of a numeric type pass as they are.
    """
    numeric, given = _is_number(raw), _as_double(raw)

    def read(text: Column, bare: Column) -> Column:
        points = F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit("")))
        signs = F.length(bare) - F.length(F.replace(bare, F.lit("-"), F.lit("")))
        number = F.when((points <= 1) & (signs <= 1) & bare.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), bare).try_cast("double")
        blank = F.lower(text).isin(BLANK_WORDS)
        value = F.when(~blank, F.when(text.rlike(r"^\(.*\)$"), -number).otherwise(number))
        return _bound(F.when(numeric, given).otherwise(value), lambda value: F.struct(value.alias("value"), F.when(raw.isNull() | (numeric & given.isNull()), "missing").when(~numeric & blank, "blank").when(value.isNull(), "unparseable").alias("reason")))

    return _bound(stripped(raw.cast("string")), lambda text: _bound(F.regexp_replace(F.regexp_replace(text, r"^\((.*)\)$", "$1"), r"[^0-9.\-]", ""), lambda bare: read(text, bare)))


def parse_day(raw: Column) -> Column:
    """The day of a date, a time or a text in a common form (month first); null where it cannot be read."""
    text = stripped(raw.cast("string"))
    bare = F.regexp_replace(text, r"[ T]+[0-9]{1,2}:[0-9]{2}.*$", "")  # the time of day

    def read(day: Column) -> Column:
        tries = [F.when(day.rlike(shape), F.to_date(F.try_to_timestamp(day, F.lit(form)))) for form, shape in DAY_FORMS.items()]
        return F.when(day.rlike("^[0-9]*$"), F.when(F.length(day) == 8, tries[-1])).otherwise(F.coalesce(*tries))

    # One element through transform and filter: the text is bound once, so the expression stays small.
    return F.get(F.filter(F.transform(F.array(bare), read), lambda day: F.year(day).between(*YEARS)), F.lit(0))


def clean_id(raw: Column) -> Column:
    """Identifier text: 38.0 becomes 38, runs of white space one space, blanks null; whole numbers never in powers of ten."""
    number = _as_double(raw)
    plain = F.when(F.typeof(raw).isin("float", "double") & (number == F.floor(number)) & (F.abs(number) < 2.0**63), number.try_cast("bigint").cast("string"))
    text = F.regexp_replace(stripped(F.coalesce(plain, raw.cast("string"))), r"\s+", " ")
    whole = F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1")
    return F.when(~F.lower(whole).isin("", "nan", "none", "<na>", "nat"), whole)


def standardise(sheet: DataFrame, name: str, extra: dict[str, list[str]] | None = None) -> DataFrame | None:
    """A sheet with `sheet`, `raw_date`, `raw_pounds` and resolved optional columns beside its own; None if it lacks a required one."""
    day, pounds = find_column(sheet.columns, DATE_HEADERS), find_column(sheet.columns, MEASURE_HEADERS)
    if day is None or pounds is None:
        return None
    out = sheet.withColumns({"sheet": F.lit(name), "date": parse_day(F.col(f"`{day}`")), "number": parse_number(F.col(f"`{pounds}`"))})
    for target, tokens in (extra or {}).items():
        found = find_column(sheet.columns, tokens)
        if found:
            out = out.withColumn(target, clean_id(F.col(f"`{found}`")))
    return out
