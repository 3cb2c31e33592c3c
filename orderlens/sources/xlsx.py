"""Reader and writer of .xlsx workbooks on the standard library, for the edges of the engine.

Sheets are read row by row from their XML, by `workbook_source` in tasks of their own, and written by tasks that render rows
to XML, which the driver only copies into the workbook's archive.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SHEET_NAME = 31
_DAY_ZERO = dt.datetime(1899, 12, 30)
_DATE_FORMS = {*range(14, 23), *range(45, 48)}  # built-in number formats of dates and times


def _column(reference: str) -> int:
    k = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        k = 26 * k + ord(c) - 64
    return k - 1


def _date_styles(styles: ElementTree.Element) -> set[int]:
    """Cell styles whose number format shows a date."""
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
    bare = {k: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f) for k, f in own.items()}
    dates = _DATE_FORMS | {k for k, f in bare.items() if re.search("[yYdD]", f)}
    cells = styles.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", "0")) in dates}


def _day_text(serial: str) -> str:
    """A date cell's day number as text, with the time of day where there is one."""
    at = _DAY_ZERO + dt.timedelta(days=float(serial))
    return at.strftime("%Y-%m-%d" if at.time() == dt.time() else "%Y-%m-%d %H:%M:%S")


def _number_text(text: str) -> str:
    """A number cell's text without powers of ten."""
    return format(Decimal(text), "f") if "e" in text.lower() else text


class Workbook:
    """An open .xlsx file; its sheets are read as streams of rows."""

    def __init__(self, source: str | IO[bytes]):
        self.book = zipfile.ZipFile(source)
        names = set(self.book.namelist())
        self._shared: list[str] | None = None if "xl/sharedStrings.xml" in names else []
        self.dates = _date_styles(self._parse("xl/styles.xml")) if "xl/styles.xml" in names else set()
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in self._parse("xl/_rels/workbook.xml.rels")}
        sheets = {s.get("name"): targets[s.get(f"{_REL}id")] for s in self._parse("xl/workbook.xml").iter(f"{_MAIN}sheet")}
        self.sheets = {n: t if t.startswith("xl/") else f"xl/{t}" for n, t in sheets.items()}

    def __enter__(self) -> Workbook:
        return self

    def __exit__(self, *_) -> None:
        self.book.close()

    def _parse(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.book.read(name))

    def _each(self, name: str, tag: str) -> Iterator[ElementTree.Element]:
        """Elements of a part one after the other; what was read is let go."""
        with self.book.open(name) as part:
            steps = ElementTree.iterparse(part, events=("start", "end"))
            _, root = next(steps)
            above = root
            for event, element in steps:
                if event == "start":
                    above = element if element.tag == f"{_MAIN}sheetData" else above
                elif element.tag == f"{_MAIN}{tag}":
                    yield element
                    above.clear()

    @property
    def shared(self) -> list[str]:
        if self._shared is None:
            self._shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in self._each("xl/sharedStrings.xml", "si")]
        return self._shared

    def rows(self, sheet: str) -> Iterator[list[str | None]]:
        """A sheet's cells as texts; date cells as yyyy-mm-dd."""
        for row in self._each(self.sheets[sheet], "row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{_MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value, kind = cell.find(f"{_MAIN}v"), cell.get("t", "n")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is not None and value.text is not None:
                    is_day = kind == "n" and int(cell.get("s", "0")) in self.dates
                    cells[at] = self.shared[int(value.text)] if kind == "s" else _day_text(value.text) if is_day else _number_text(value.text) if kind == "n" else value.text
            yield cells


def read_workbook(path: str) -> dict[str, list[list[str | None]]]:
    """Every sheet's cells as texts, by sheet name in workbook order, in this process; for small workbooks."""
    with Workbook(path) as book:
        return {name: list(book.rows(name)) for name in book.sheets}


def column_names(header: list[str | None]) -> list[str]:
    """Names of the first row; one without a name gets its place, one that comes again a number."""
    named = [h or f"column{k}" for k, h in enumerate(header)]
    return [h if h not in named[:k] else f"{h}.{named[:k].count(h)}" for k, h in enumerate(named)]


def sheet_frames(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sheets as DataFrames of texts, by name in workbook order; the first row names the columns.

    This process reads the sheets' first rows only; all others are read by tasks, one for each sheet.
    """
    from . import workbook_source

    workbook_source.register(spark)
    out = {}
    with Workbook(workbook_source.opened(path)) as book:
        for name in book.sheets:
            first = next(book.rows(name), None)
            if first is not None:
                schema = StructType([StructField(h, StringType()) for h in column_names(first)])
                out[name] = spark.read.format(workbook_source.NAME).schema(schema).option("sheet", name).load(path)
    return out


DAY_FORMAT = "yyyy-mm-dd"
# Number formats of the reports, and the fill of forecast rows.
WHOLE, TENTH, THOUSANDTH, FORECAST_FILL = "#,##0", "#,##0.0", "0.000", "FFF3CD"
MOST_ROWS = 1_048_575


@dataclass
class Look:
    """How a sheet looks: number formats by column, rows to fill (column, value, colour), columns and rows that stay in view."""

    formats: dict[str, str] = field(default_factory=dict)
    highlight: tuple[str, str, str] | None = None
    frozen: tuple[int, int] = (0, 1)
    widths: dict[str, int] = field(default_factory=dict)


class _Styles:
    """The cell styles of a workbook: 0 plain, 1 header, then every number format with every fill."""

    def __init__(self, looks: Iterable[Look]):
        held = list(looks)
        self.formats = ["", DAY_FORMAT, *sorted({f for x in held for f in x.formats.values()} - {DAY_FORMAT})]
        self.fills = ["", *sorted({x.highlight[2] for x in held if x.highlight})]

    def of(self, form: str, fill: str) -> int:
        return 2 + self.formats.index(form) * len(self.fills) + self.fills.index(fill)

    def xml(self) -> str:
        number = {f: 164 + k for k, f in enumerate(self.formats[1:])}
        forms = "".join(f'<numFmt numFmtId="{i}" formatCode="{escape(f, _QUOTE)}"/>' for f, i in number.items())
        fills = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9D9D9"/></patternFill></fill>'
        fills += "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in self.fills[1:])
        cells = '<xf numFmtId="0" fontId="0" fillId="0" borderId="0"/><xf numFmtId="0" fontId="1" fillId="2" borderId="0" applyFont="1" applyFill="1"/>'
        cells += "".join(f'<xf numFmtId="{number.get(f, 0)}" fontId="0" fillId="{j + 2 if j else 0}" borderId="0" applyNumberFormat="1" applyFill="1"/>' for f in self.formats for j in range(len(self.fills)))
        return f'<styleSheet xmlns="{_MAIN[1:-1]}"><numFmts count="{len(number)}">{forms}</numFmts><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts><fills count="{len(self.fills) + 2}">{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs count="{2 + len(self.formats) * len(self.fills)}">{cells}</cellXfs></styleSheet>'


_QUOTE = {chr(34): "&quot;"}
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _letters(k: int) -> str:
    return ("" if k < 26 else _letters(k // 26 - 1)) + chr(65 + k % 26)


def _cell(value, style: int, day_style: int) -> str:
    if value is None:
        return f'<c s="{style}"/>' if style else "<c/>"
    if isinstance(value, (dt.date, dt.datetime)):
        at = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
        return f'<c s="{day_style}"><v>{(at - _DAY_ZERO) / dt.timedelta(1):.10g}</v></c>'
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return f'<c s="{style}"><v>{value if isinstance(value, Decimal) else repr(value)}</v></c>'
    return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _renderer(columns: list[str], look: Look, styles: _Styles):
    """Renders rows (lists of values) to XML; cells follow one another, so a row needs no number."""
    forms = [look.formats.get(c, "") for c in columns]
    fills = ["", look.highlight[2]] if look.highlight else [""]
    plain = [[styles.of(f, fill) for f in forms] for fill in fills]
    days = [styles.of(DAY_FORMAT, fill) for fill in fills]
    at = columns.index(look.highlight[0]) if look.highlight and look.highlight[0] in columns else None

    def render(rows: Iterable[list]) -> str:
        out = []
        for row in rows:
            filled = int(at is not None and str(row[at]) == look.highlight[1])
            out.append("<row>" + "".join(_cell(v, s, days[filled]) for v, s in zip(row, plain[filled], strict=True)) + "</row>")
        return "".join(out)

    return render


def _write(path: str, sheets: dict[str, tuple[list[str], Iterator[str]]], looks: dict[str, Look], styles: _Styles, groups: dict[str, list[tuple[str, int]]]) -> None:
    """Sheets of columns and rendered rows, in their order; rows are copied as they come."""
    names = [n[:SHEET_NAME] for n in sheets]
    kinds, office = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        parts = [("xl/workbook.xml", "sheet.main"), ("xl/styles.xml", "styles"), *((f"xl/worksheets/sheet{k}.xml", "worksheet") for k in range(1, len(names) + 1))]
        book.writestr("[Content_Types].xml", _HEAD + f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/{n}" ContentType="{office}.{t}+xml"/>' for n, t in parts) + "</Types>")
        relation = lambda k, t, to: f'<Relationship Id="rId{k}" Type="{_REL[1:-1]}/{t}" Target="{to}"/>'
        book.writestr("_rels/.rels", _HEAD + f'<Relationships xmlns="{kinds}/relationships">{relation(1, "officeDocument", "xl/workbook.xml")}</Relationships>')
        book.writestr("xl/workbook.xml", _HEAD + f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(n, _QUOTE)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", _HEAD + f'<Relationships xmlns="{kinds}/relationships">' + "".join(relation(k, "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(names) + 1)) + relation(len(names) + 1, "styles", "styles.xml") + "</Relationships>")
        book.writestr("xl/styles.xml", _HEAD + styles.xml())
        for k, (name, (columns, rows)) in enumerate(sheets.items(), 1):
            look, above, merged = looks.get(name, Look()), [], ""
            for title, width in groups.get(name, []):
                if width > 1:
                    merged += f'<mergeCell ref="{_letters(len(above))}1:{_letters(len(above) + width - 1)}1"/>'
                above += [title] + [None] * (width - 1)
            while above and above[-1] is None:
                above.pop()
            across, down = look.frozen[0], look.frozen[1] + bool(above)
            pane = f'<sheetViews><sheetView workbookViewId="0"><pane xSplit="{across}" ySplit="{down}" topLeftCell="{_letters(across)}{down + 1}" state="frozen"/></sheetView></sheetViews>'
            wide = "".join(f'<col min="{i}" max="{i}" width="{look.widths[c]}" customWidth="1"/>' for i, c in enumerate(columns, 1) if c in look.widths)
            titled = lambda cells: "<row>" + "".join(_cell(v, 1, 1) for v in cells) + "</row>"
            with book.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as part:
                part.write((_HEAD + f'<worksheet xmlns="{_MAIN[1:-1]}">{pane}{wide and f"<cols>{wide}</cols>"}<sheetData>' + (titled(above) if above else "") + titled(columns)).encode())
                for text in rows:
                    part.write(text.encode())
                part.write(("</sheetData>" + (merged and f"<mergeCells>{merged}</mergeCells>") + "</worksheet>").encode())


def write_workbook(path: str, tables: dict[str, tuple[list[str], Iterable[Iterable]]], groups: dict[str, list[tuple[str, int]]] | None = None, looks: dict[str, Look] | None = None) -> None:
    """Small tables as sheets; an empty table gets a note.

    `groups` gives a sheet a row above its header: titles, each merged over a number of columns.
    """
    looks = looks or {}
    styles = _Styles(looks.values())
    sheets = {}
    for name, (columns, rows) in tables.items():
        held = [list(r) for r in rows] or [["no data"] + [None] * (len(columns) - 1)]
        held = [r + [None] * (len(columns) - len(r)) for r in held]
        sheets[name] = (columns, iter([_renderer(columns, looks.get(name, Look()), styles)(held)]))
    _write(path, sheets, looks, styles, groups or {})


def _rendered(frame: DataFrame, name: str, look: Look, styles: _Styles) -> Iterator[str]:
    """Rows rendered by tasks; one task's at a time comes here, as text."""
    columns = frame.columns
    render = _renderer(columns, look, styles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([render(list(r) for r in rows)])], names=["n", "xml"])

    total = 0
    for row in frame.mapInArrow(run, "n bigint, xml string").toLocalIterator():
        total += row["n"]
        if total > MOST_ROWS:
            raise ValueError(f"{name} has too many rows for a sheet")
        yield row["xml"]
    if not total:
        yield render([["no data"] + [None] * (len(columns) - 1)])


def write_frames(path: str, sheets: dict[str, DataFrame], groups: dict[str, list[tuple[str, int]]] | None = None, looks: dict[str, Look] | None = None) -> None:
    """DataFrames as sheets, in their order. A sheet holds `MOST_ROWS` rows at most; a larger table raises, for CSV has no limit."""
    looks = looks or {}
    styles = _Styles(looks.values())
    _write(path, {name: (frame.columns, _rendered(frame, name, looks.get(name, Look()), styles)) for name, frame in sheets.items()}, looks, styles, groups or {})


def write_csv(frame: DataFrame, folder: str) -> None:
    """A folder of CSV files with headers, written by the executors."""
    frame.write.mode("overwrite").csv(folder, header=True)
