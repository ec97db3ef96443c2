"""Folders of spreadsheet workbooks, one task per file, in bulk.

A worksheet holds at most 1,048,576 rows by format, and its XML is read as a stream, so a
task's memory is bounded by one workbook's compressed bytes and shared strings.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.functions.values import TypedColumn, parse_text, typed_columns
from tablewright.schema import check_names

# XML namespaces and built-in date formats of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
ROW, CELL, VALUE, TEXT = (MAIN + tag for tag in ("row", "c", "v", "t"))
ROWS_PER_BATCH = 4096


@lru_cache(maxsize=16384)
def column_index(letters: str) -> int:
    number = 0
    for letter in letters.upper():
        number = number * 26 + ord(letter) - 64
    return number


def parse_range(text: str) -> tuple[int, int, int, int]:
    """``A1:C9`` as first row, first column, last row, last column."""
    match = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+):\$?([A-Za-z]{1,3})\$?(\d+)", text.strip())
    if not match:
        raise TabularError("workbook.range", f"invalid range '{text}'")
    c1, r1, c2, r2 = column_index(match[1]), int(match[2]), column_index(match[3]), int(match[4])
    return min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)


def _part(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _sheet_path(book: zipfile.ZipFile, worksheet: str) -> str:
    for sheet in _part(book, "xl/workbook.xml").iter(f"{MAIN}sheet"):
        if sheet.get("name", "").lower() == worksheet.lower():
            wanted = sheet.get(f"{REL}id")
            for rel in _part(book, "xl/_rels/workbook.xml.rels").iter(f"{PACKAGE_REL}Relationship"):
                if rel.get("Id") == wanted:
                    target = rel.get("Target")
                    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise TabularError("workbook.worksheet", f"worksheet '{worksheet}' does not exist")


def _strings(book: zipfile.ZipFile) -> list[str]:
    root = _part(book, "xl/sharedStrings.xml")
    return [] if root is None else ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in root.iter(f"{MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    root = _part(book, "xl/styles.xml")
    if root is None:
        return set()
    custom = {
        int(f.get("numFmtId"))
        for f in root.iter(f"{MAIN}numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.IGNORECASE)
    }
    cell_formats = root.find(f"{MAIN}cellXfs")
    formats = [] if cell_formats is None else [int(x.get("numFmtId", 0)) for x in cell_formats]
    return {i for i, f in enumerate(formats) if f in DATE_FORMATS or f in custom}


def _moment(serial: float) -> str:
    """A serial day number as text; day 60 does not exist."""
    days = serial + 1 if serial < 60 else serial
    moment = datetime(1899, 12, 30) + timedelta(seconds=round(days * 86400 * 1000) / 1000)
    return moment.strftime("%m/%d/%Y %H:%M:%S")


def _cell_text(cell: ElementTree.Element, strings: list[str], date_styles: set[int]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(TEXT))
    value = cell.findtext(VALUE) or ""
    if not value:
        return ""
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind == "n" and date_styles and int(cell.get("s", 0)) in date_styles:
        return _moment(float(value))
    whole, dot, fraction = value.partition(".")
    return whole if dot and kind == "n" and not fraction.strip("0") else value


def sheet_rows(content: bytes, worksheet: str) -> Iterator[tuple[int, dict[int, str]]]:
    """Row number and its non-empty cells by column number."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, date_styles = _strings(book), _date_styles(book)
        row_number = 0
        with book.open(_sheet_path(book, worksheet)) as stream:
            for _, element in ElementTree.iterparse(stream):
                if element.tag != ROW:
                    continue
                row_number = int(element.get("r", row_number + 1))
                cells: dict[int, str] = {}
                position = 0
                for cell in element.iter(CELL):
                    letters = cell.get("r", "").rstrip("0123456789")
                    position = column_index(letters) if letters else position + 1
                    text = _cell_text(cell, strings, date_styles)
                    if text != "":
                        cells[position] = text
                element.clear()
                if cells:
                    yield row_number, cells


def used_range(content: bytes, worksheet: str, cell_range: str | None) -> tuple[int, int, int, int]:
    if cell_range is not None:
        return parse_range(cell_range)
    first_row = last_row = first_column = last_column = 0
    for row, cells in sheet_rows(content, worksheet):
        first_row, last_row = first_row or row, row
        first_column = min(first_column or min(cells), min(cells))
        last_column = max(last_column, max(cells))
    if not last_row:
        raise TabularError("workbook.empty", f"worksheet '{worksheet}' is empty")
    return first_row, first_column, last_row, last_column


def grid(content: bytes, worksheet: str, cell_range: str | None, has_header: bool) -> Iterator[list[str]]:
    """Every row of the range as cell texts, blank rows included.

    Under a header the used range can only be as wide as the header, since it may have no
    empty names, so one pass over the sheet does; otherwise its bounds are looked up first.
    """
    rows = sheet_rows(content, worksheet)
    if cell_range is None and has_header:
        top, names = next(rows, (0, {}))
        if not names:
            raise TabularError("workbook.empty", f"worksheet '{worksheet}' is empty")
        left, right, bottom = min(names), max(names), None
        yield [names.get(c, "") for c in range(left, right + 1)]
        expected = top + 1
    else:
        top, left, bottom, right = used_range(content, worksheet, cell_range)
        expected = top
    blank = [""] * (right - left + 1)
    for row, cells in rows:
        if row < top:
            continue
        if bottom is None:
            if min(cells) < left or max(cells) > right:
                raise TabularError("file.header.mismatch", f"row {row} is wider than the header")
        elif row > bottom:
            break
        while expected < row:
            yield list(blank)
            expected += 1
        yield [cells.get(c, "") for c in range(left, right + 1)]
        expected = row + 1
    while bottom is not None and expected <= bottom:
        yield list(blank)
        expected += 1


def read_workbooks(
    spark: SparkSession,
    path: str,
    worksheet: str,
    cell_range: str | None = None,
    has_header: bool = True,
    columns: Sequence[TypedColumn | dict] | None = None,
    max_columns: int = 1024,
) -> DataFrame:
    """Rows of one worksheet (or a range of it) of every workbook below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path)
    return workbook_rows(files, worksheet, cell_range, has_header, columns, max_columns)


def workbook_rows(
    files: DataFrame,
    worksheet: str,
    cell_range: str | None = None,
    has_header: bool = True,
    columns: Sequence[TypedColumn | dict] | None = None,
    max_columns: int = 1024,
) -> DataFrame:
    """Rows of one worksheet of every workbook in the binary column ``content``."""
    typed = typed_columns(columns) if columns is not None else None
    if typed is None:
        if not has_header:
            raise TabularError("file.columns.required", "files without a header need explicit columns")
        typed = [TypedColumn(n) for n in _header(files, worksheet, cell_range)]
        check_names([c.name for c in typed])
    if len(typed) > max_columns:
        raise TabularError("file.columns", f"at most {max_columns} columns")
    names = [c.name for c in typed]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                pending: list[list[str]] = []
                for i, cells in enumerate(grid(bytes(content), worksheet, cell_range, has_header)):
                    if i == 0 and has_header:
                        if [c.strip().lower() for c in cells] != [n.lower() for n in names]:
                            raise ValueError("file.header.mismatch: the header does not match the columns")
                        continue
                    if len(cells) != len(names):
                        raise ValueError("file.columns: the range does not have the configured columns")
                    pending.append(cells)
                    if len(pending) == ROWS_PER_BATCH:
                        yield pd.DataFrame(pending, columns=names)
                        pending = []
                if pending:
                    yield pd.DataFrame(pending, columns=names)

    text = files.select("content").mapInPandas(rows, ", ".join(f"`{n}` string" for n in names))
    return text.select(
        *[parse_text(F.col(f"`{c.name}`"), c.type, c.nullable, c.name, scale=c.scale).alias(c.name) for c in typed]
    )


def _header(files: DataFrame, worksheet: str, cell_range: str | None) -> list[str]:
    """Header of the first workbook, read by a task; only its names reach the driver."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame({"names": [next(grid(bytes(content), worksheet, cell_range, True))]})

    found = files.select("content").limit(1).mapInPandas(first, "names array<string>").collect()
    if not found:
        raise TabularError("file.empty", "no workbook found")
    return [n.strip() for n in found[0]["names"]]
