"""Workbooks as a data source of Spark: a task for each sheet of each workbook.

    spark.read.format("orderlens_xlsx").option("sheet", "24HY1").load("orders.xlsx")
    spark.read.format("orderlens_xlsx").load("folder of workbooks")

With `sheet` the rows of that sheet, in all workbooks that have it, under the names of its first row, all as texts; without
it every sheet's rows as (workbook, sheet, row, cells), the header among them as row 1. The path is a workbook or a folder
of them, on any file system that Arrow opens. `register` makes the source known to a session.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import xlsx

NAME = "orderlens_xlsx"
CHUNK = 5_000
EVERY = StructType([StructField("workbook", StringType()), StructField("sheet", StringType()), StructField("row", LongType()), StructField("cells", ArrayType(StringType()))])


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{posixpath.abspath(path)}")


def opened(path: str) -> IO[bytes]:
    """A workbook as a seekable stream."""
    system, at = _system(path)
    return system.open_input_file(at)


def workbooks(path: str) -> list[str]:
    """The workbook of the path, or all of the folder."""
    system, at = _system(path)
    scheme = path.split("://")[0] if "://" in path else "file"
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(at))
    return [f"{scheme}://{f.path}" for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".xlsx") and not f.base_name.startswith("~")]


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str


class SheetReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.path, self.sheet = schema.fieldNames(), options["path"], options.get("sheet")

    def partitions(self) -> list[Sheet]:
        found = []
        for path in workbooks(self.path):
            with xlsx.Workbook(opened(path)) as book:
                found += [Sheet(path, name) for name in book.sheets if self.sheet in (None, name)]
        return found

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        with xlsx.Workbook(opened(partition.path)) as book:
            rows = book.rows(partition.sheet)
            yield from self._every(partition, rows) if self.sheet is None else self._named(rows)

    def _named(self, rows: Iterator[list[str | None]]) -> Iterator[pa.RecordBatch]:
        header = {name: k for k, name in reversed(list(enumerate(xlsx.column_names(next(rows, [])))))}
        places = [header.get(name) for name in self.names]
        for chunk in _chunks(rows):
            yield pa.RecordBatch.from_arrays([pa.array([None if at is None or at >= len(r) else r[at] for r in chunk], pa.string()) for at in places], names=self.names)

    def _every(self, partition: Sheet, rows: Iterator[list[str | None]]) -> Iterator[pa.RecordBatch]:
        n = 0
        for chunk in _chunks(rows):
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(chunk)), pa.array([partition.sheet] * len(chunk)), pa.array(range(n + 1, n + len(chunk) + 1), pa.int64()), pa.array(chunk, pa.list_(pa.string()))], names=EVERY.fieldNames())
            n += len(chunk)


def _chunks(rows: Iterator[list[str | None]]) -> Iterator[list[list[str | None]]]:
    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == CHUNK:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        wanted = self.options.get("sheet")
        if wanted is None:
            return EVERY
        for path in workbooks(self.options["path"]):
            with xlsx.Workbook(opened(path)) as book:
                if wanted in book.sheets:
                    return StructType([StructField(h, StringType()) for h in xlsx.column_names(next(book.rows(wanted), []))])
        raise ValueError(f"no workbook has a sheet {wanted!r}")

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
