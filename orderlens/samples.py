"""Small inputs that queries and their SQL share: event lists, and texts as exports hold them."""

EVENTS = [("1998-03-10", None), ("1999-03-09", 12.0), ("1999-03-09", 15.0), ("2000-03-14", None), ("2000-10-31", 10.0), ("2001-08-07", None), ("2001-08-09", 25.0), ("2001-08-09", None), ("2030-01-01", 5.0)]
EVENT_TEXTS = ["2026-09-20, 2026-09-21", "2026-09-20, soon,, 2026-10-01 "]
NUMBERS = ["12", "12.5", "1,234.50", " 1 234.5 ", "$1,234.5", "12 lbs", "(1,000)", "(-5)", "", "  ", "N/A", "\tN/A\n", "na", "None", "nan", "-", "abc", ".", "-.", "1.2.3", "--5", "5-", "1e5", "−5", None]
HEADERS = ["Mat.avail.dt", " MAT_AVAIL_DT ", "mat avail dt", "Net Pounds", "Order#"]
IDS = ["38", "38.0", "38.5", "AB  402517", " x ", "\ty\n", "", "nan", None]
SHEETS = ["24HY1", "24H1", "24 hy 1", "2024H1", "24H3", "Summary", "25 H2"]
# Day texts, and the days that they are.
DAYS = [("2024-01-05", "2024-01-05"), ("3/15/2024", "2024-03-15"), ("15-Mar-24", "2024-03-15"), ("45292", None), ("20240105", "2024-01-05"), ("2024-01-05 13:00:00", "2024-01-05"), ("2024-01-05T13:00:00", "2024-01-05"), (" 1/2/24\t", "2024-01-02"), ("Jan 5, 2024", "2024-01-05"), ("soon", None), ("12024-01-01", None), (None, None)]
# Kinds of texts: their forms, the mark that a line's value takes the place of, and that value as an expression of SQL.
TEXTS = {
    "headers": (HEADERS, "#", "cast(l_orderkey as string)"),
    "numbers": (NUMBERS, "12", "cast(cast(l_quantity as int) as string)"),
    "ids": (IDS, "38", "cast(l_partkey as string)"),
    "sheets": (SHEETS, "24", "right(cast(year(l_shipdate) as string), 2)"),
    "events": (EVENT_TEXTS, "2026-09-20", "cast(cast(l_shipdate as date) as string)"),
}
# Forms of day texts, and what they say: the day, the day in this century (two digits), or nothing that can be read.
DAY_TEXTS = [
    ("yyyy-MM-dd", "day"), ("M/d/yyyy", "day"), ("dd-MMM-yy", "short"), ("'45'DDD", "none"), ("yyyyMMdd", "day"), ("yyyy-MM-dd HH:mm:ss", "day"), ("yyyy-MM-dd'T'HH:mm:ss", "day"),
    ("' 'M/d/yy'\t'", "short"), ("MMM d, yyyy", "day"), ("'soon'", "none"), ("'1'yyyy-MM-dd", "none"), ("d.M.yyyy", "day"), ("dd MMM yyyy", "day"), ("yyyy/M/d", "day"),
]
