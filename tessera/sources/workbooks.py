"""Workbooks (xlsx) as row sections: a file is unzipped and parsed within its task, all else is DataFrame work."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the format, built-in number formats that are days or times, and letters of custom ones.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DAY_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_DAY_LETTERS = re.compile(r"[ymdhs]", re.I)
_NOT_LETTERS = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')
_EPOCH, _EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)

ROWS = "doc string, ordinal long, kind string, heading string, anchor string, text string, cells array<struct<ref: string, value: string, number: double>>"
_KIND = pa.schema(
    [("doc", pa.string()), ("ordinal", pa.int64()), ("kind", pa.string()), ("heading", pa.string()), ("anchor", pa.string()), ("text", pa.string()), ("cells", pa.list_(pa.struct([("ref", pa.string()), ("value", pa.string()), ("number", pa.float64())])))]
)


def _texts(item: ElementTree.Element) -> str:
    """The text of a string with or without runs; phonetic readings are left out."""
    return "".join(t.text or "" for child in item for t in ([child] if child.tag == f"{_MAIN}t" else child.iter(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else ()))


def _day_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of cell styles that write days or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_MAIN}numFmt")}
    days = {k for k, code in own.items() if _DAY_LETTERS.search(_NOT_LETTERS.sub("", code)) and code.lower() != "general"}
    formats = root.find(f"{_MAIN}cellXfs")
    return {k for k, xf in enumerate(formats if formats is not None else ()) if (n := int(xf.get("numFmtId") or 0)) in days or n in _DAY_FORMATS and n not in own}


def _moment(serial: float, epoch: dt.datetime) -> str:
    """A serial number as an ISO day and time; below one, a time alone."""
    moment = epoch + dt.timedelta(milliseconds=round(serial * 86_400_000))
    return moment.time().isoformat() if 0 <= serial < 1 else moment.isoformat()


def _value(cell: ElementTree.Element, strings: list[str], days: set[int], epoch: dt.datetime) -> str | int | float | None:
    kind = cell.get("t") or "n"
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return _texts(inline) if inline is not None else None
    held = cell.find(f"{_MAIN}v")
    if held is None or held.text is None:
        return None
    if kind == "s":
        return strings[int(held.text)]
    if kind == "b":
        return str(held.text == "1")
    if kind in ("str", "e"):
        return held.text
    if kind == "d":
        return held.text
    number = float(held.text)
    if int(cell.get("s") or 0) in days:
        return _moment(number, epoch)
    return int(number) if number.is_integer() and not re.search("[.eE]", held.text) else number


def sheet_rows(content: bytes) -> Iterator[tuple[str, list[tuple[str, str | int | float]]]]:
    """(sheet, its cells that hold something, as (ref, value)) of every row that has any, sheet by sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        strings = [_texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        days = _day_styles(book)
        settings = root.find(f"{_MAIN}workbookPr")
        epoch = _EPOCH_1904 if settings is not None and settings.get("date1904") in ("1", "true") else _EPOCH
        for sheet in root.iter(f"{_MAIN}sheet"):
            target = links.get(sheet.get(_LINK)) or ""
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if path not in book.namelist() or "chartsheet" in path:
                continue
            number = 0
            with book.open(path) as stream:
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != f"{_MAIN}row":
                        continue
                    number = int(row.get("r") or number + 1)
                    column, cells = 0, []
                    for cell in row.iter(f"{_MAIN}c"):
                        ref = cell.get("r")
                        column = _index(ref) if ref else column + 1
                        value = _value(cell, strings, days, epoch)
                        if value is not None and str(value).strip():
                            cells.append((ref or f"{_letters(column)}{number}", value))
                    if cells:
                        yield sheet.get("name") or "", cells
                    row.clear()


def _index(ref: str) -> int:
    out = 0
    for c in ref:
        if not c.isalpha():
            break
        out = out * 26 + ord(c.upper()) - 64
    return out


def _letters(column: int) -> str:
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, content in zip(batch.column("doc").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows: list[dict] = []
            try:
                for k, (sheet, cells) in enumerate(sheet_rows(content), 1):
                    held = [{"ref": ref, "value": str(v), "number": None if isinstance(v, str) else float(v)} for ref, v in cells]
                    rows.append({"doc": doc, "ordinal": k, "kind": "row", "heading": sheet, "anchor": f"{doc}#{sheet}!{cells[0][0]}", "text": " | ".join(str(v) for _, v in cells), "cells": held})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_KIND)
                        rows = []
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                pass  # see workbook_sections
            yield pa.RecordBatch.from_pylist(rows, schema=_KIND)


def workbook_sections(files: DataFrame) -> DataFrame:
    """Rows of workbooks (doc, content) as sections: doc, ordinal, kind, heading (the sheet), anchor (its first cell), text, cells.

    A cell has its ref, its value as text, and its number if it is one.  Values are the cached ones of
    formulas; days and times are ISO texts; cells without anything but white space, and rows
    without cells, are left out.  No row is a header.  A file is held in its task, a row at a time;
    one that is no workbook has the rows that could be read before it broke, if any.
    """
    return files.where(F.lower("doc").rlike(r"\.xlsx$")).select("doc", "content").mapInArrow(_parsed, ROWS)
