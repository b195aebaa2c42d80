"""Anchors `doc#place`: the six kinds of places, written and read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How places are written, in the order in which they are tried.
PLACES = (
    ("page-table-row", r"^p([0-9]+)t([0-9]+)r([0-9]+)$", ("page", "table", "row")),
    ("page-line", r"^p([0-9]+)l([0-9]+)$", ("page", "line")),
    ("message-line", r"^m([0-9]+)l([0-9]+)$", ("message", "line")),
    ("line", r"^l([0-9]+)$", ("line",)),
    ("row", r"^r([0-9]+)$", ("row",)),
    ("sheet-cell", r"^(.+)!([A-Z]+)([0-9]+)$", ("sheet", "column", "row")),
)
_FIELDS = ("page", "line", "message", "table", "sheet", "column", "row")


def _anchor(doc: Column, *parts: str | Column) -> Column:
    return F.concat(doc.cast("string"), F.lit("#"), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def page_line(doc: Column, page: Column, line: Column) -> Column:
    return _anchor(doc, "p", page, "l", line)


def page_table_row(doc: Column, page: Column, table: Column, row: Column) -> Column:
    return _anchor(doc, "p", page, "t", table, "r", row)


def message_line(doc: Column, message: Column, line: Column) -> Column:
    return _anchor(doc, "m", message, "l", line)


def sheet_cell(doc: Column, sheet: Column, column: Column, row: Column) -> Column:
    return _anchor(doc, sheet, "!", column, row)


def row_anchor(doc: Column, row: Column) -> Column:
    return _anchor(doc, "r", row)


def document_of(anchor: Column) -> Column:
    """What stands before the last `#`; empty if there is none."""
    return F.regexp_extract(anchor, "(?s)^(.*)#", 1)


def place_of(anchor: Column) -> Column:
    return F.regexp_extract(anchor, "(?s)^.*#(.*)$", 1)


def parse_anchor(anchor: Column) -> Column:
    """struct(doc, kind, page, line, message, table, sheet, column, row); null if it is no anchor."""
    doc, place, out = document_of(anchor), place_of(anchor), F.lit(None)
    for kind, pattern, names in reversed(PLACES):
        part = lambda k, n: F.regexp_extract(place, pattern, k + 1) if n in ("sheet", "column") else F.regexp_extract(place, pattern, k + 1).try_cast("int")  # noqa: B023, E731
        fields = {n: part(k, n) for k, n in enumerate(names)}
        whole = F.struct(doc.alias("doc"), F.lit(kind).alias("kind"), *(fields.get(n, F.lit(None).cast("string" if n in ("sheet", "column") else "int")).alias(n) for n in _FIELDS))
        out = F.when((doc != "") & place.rlike(pattern), whole).otherwise(out)
    return out


def column_of(ref: Column) -> Column:
    """The column of a cell: its letters in a workbook, `c<n>` in a csv file, a page table or a line table; else null."""
    letters, number = F.regexp_extract(ref, "^([A-Z]+)[0-9]+$", 1), F.regexp_extract(ref, "^(?:t[0-9]+)?(?:r[0-9]+)?c([0-9]+)$", 1)
    return F.when(letters != "", letters).when(number != "", F.concat(F.lit("c"), number))


def table_of(anchor: Column) -> Column:
    """The table of a row: a sheet, `p<page>t<table>`, or '' for a csv file; else null."""
    a = parse_anchor(anchor)
    return F.when(a["kind"] == "sheet-cell", a["sheet"]).when(a["kind"] == "row", "").when(a["kind"] == "page-table-row", F.concat(F.lit("p"), a["page"], F.lit("t"), a["table"]))


def cell_anchor(doc: Column, sheet: Column, ref: Column, own: Column) -> Column:
    """A workbook cell's own anchor; other rows keep theirs."""
    return F.when(place_of(own).rlike(PLACES[5][1]), _anchor(doc, sheet, "!", ref)).otherwise(own)
