"""Workbook scans (``.xlsx``): many files at once, one task per group of files.

A workbook is a zip of XML parts, which only one reader can walk, and the format caps
a sheet at 1,048,576 rows: the file is the unit of work, and Spark spreads the files.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.text import quoted
from gridweave.operators.positions import as_ranges, in_ranges
from gridweave.operators.tables import infer_types as cast_inferred
from gridweave.sources.csv import FILE_ORDER, unique_names

WORKBOOK_SUFFIXES = (".xlsx",)
CELL_SCHEMA = "path string, sheet string, sheet_number int, line bigint, cells array<string>"
_BATCH_ROWS = 5_000
# Built-in number formats that show a date or a time.
_DATE_FORMATS = set(range(14, 23)) | {45, 46, 47}


def scan_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every sheet: ``(path, sheet, sheet_number, line, cells)``, cells as text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    return files.select("path", "content").mapInPandas(_workbook_rows, CELL_SCHEMA)


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sheet_number, sheet)`` of every workbook."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    return files.select("path", "content").mapInPandas(_sheet_rows, "path string, sheet_number int, sheet string")


def read_workbook(
    spark: SparkSession,
    path: str,
    *,
    sheet: str | None = None,
    skip: str | int | Iterable[int] | None = None,
    infer_types: bool = False,
    with_order: bool = False,
) -> DataFrame:
    """One sheet of each workbook as a table; by default the first sheet.

    The first row not skipped is the header. The workbooks of one scan share a layout.
    """
    ranges = as_ranges(skip)
    rows = scan_workbooks(spark, path).where(F.col("sheet") == sheet if sheet else F.col("sheet_number") == 0)
    rows = rows.where(~in_ranges(F.col("line"), ranges) & (F.size(F.filter("cells", lambda c: c.isNotNull())) > 0))
    top = rows.limit(1).select("line", "cells").collect()
    if not top:
        raise ValueError(f"there is no header in {path!r}" + (f", sheet {sheet!r}" if sheet else ""))
    names = unique_names(top[0]["cells"])
    order = [F.col("path").alias("_file"), F.lit(0).cast("bigint").alias("_block"), F.col("line").alias("_row")]
    body = rows.where(F.col("line") > top[0]["line"])
    fields = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)]
    table = body.select(*fields, *order)
    table = cast_inferred(table.select(*[quoted(c) for c in names], *FILE_ORDER)) if infer_types else table
    return table if with_order else table.select(*[quoted(c) for c in names])


def _workbook_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            book = _Workbook(content)
            for number, (name, part) in enumerate(book.sheets):
                rows = []
                for line, cells in book.rows(part):
                    rows.append((path, name, number, line, cells))
                    if len(rows) == _BATCH_ROWS:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)


def _sheet_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            found = [(path, i, name) for i, (name, _) in enumerate(_Workbook(content).sheets)]
            yield pd.DataFrame(found, columns=["path", "sheet_number", "sheet"])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "sheet", "sheet_number", "line", "cells"])


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


class _Workbook:
    """The parts of one workbook that hold cell values."""

    def __init__(self, content: bytes):
        self._zip = zipfile.ZipFile(io.BytesIO(content))
        targets = {r.get("Id"): r.get("Target") for r in self._part("xl/_rels/workbook.xml.rels").iter()}
        book = self._part("xl/workbook.xml")
        relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        self.sheets = [
            (s.get("name"), posixpath.normpath(posixpath.join("/xl", targets[s.get(relation)])).lstrip("/"))
            for s in book.iter()
            if _tag(s) == "sheet"
        ]
        self._late_epoch = any(_tag(p) == "workbookPr" and p.get("date1904") in ("1", "true") for p in book.iter())
        names = set(self._zip.namelist())
        self._strings = []
        if "xl/sharedStrings.xml" in names:
            strings = self._part("xl/sharedStrings.xml")
            self._strings = [_text(s) for s in strings if _tag(s) == "si"]
        self._dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _part(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self._zip.read(name))

    def _date_styles(self) -> set[int]:
        styles = self._part("xl/styles.xml")
        custom = {
            int(f.get("numFmtId"))
            for f in styles.iter()
            if _tag(f) == "numFmt" and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))
        }
        for group in styles:
            if _tag(group) == "cellXfs":
                kinds = [int(x.get("numFmtId", "0")) for x in group]
                return {i for i, kind in enumerate(kinds) if kind in _DATE_FORMATS or kind in custom}
        return set()

    def rows(self, part: str) -> Iterator[tuple[int, list[str | None]]]:
        with self._zip.open(part) as stream:
            line = -1
            for _, row in ElementTree.iterparse(stream):
                if _tag(row) != "row":
                    continue
                line = int(row.get("r")) - 1 if row.get("r") else line + 1
                cells: list[str | None] = []
                for cell in row:
                    place = _column_number(cell.get("r"), len(cells))
                    cells.extend([None] * (place - len(cells)))
                    cells.append(self._value(cell))
                yield line, cells
                row.clear()

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return _text(cell)
        raw = next((v.text for v in cell if _tag(v) == "v"), None)
        if raw is None:
            return None
        if kind == "s":
            return self._strings[int(raw)]
        if kind == "b":
            return "True" if raw == "1" else "False"
        if kind == "e":
            return None
        if kind == "n" and int(cell.get("s", "0")) in self._dates:
            return self._moment(float(raw))
        return raw

    def _moment(self, serial: float) -> str:
        # Serial 60 is a day that never was, so days before it count from one later.
        start = datetime(1904, 1, 1) if self._late_epoch else datetime(1899, 12, 30 if serial >= 60 else 31)
        moment = start + timedelta(milliseconds=round(serial * 86_400_000))
        return moment.isoformat(sep=" ")


def _column_number(reference: str | None, fallback: int) -> int:
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return fallback
    number = 0
    for letter in letters.group():
        number = number * 26 + ord(letter) - 64
    return number - 1
