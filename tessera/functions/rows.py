"""Rows `- head | doc | quote | anchor`, comparisons of them, and citations `[doc | anchor]`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import collapsed

# Words of a quote up to which it can stand in a sentence, how citations and list marks are written.
QUOTABLE_WORDS = 40
CITATION = r"\[\s*(?:[^\[\]|]+\|[^\[\]|]+|[^\[\]|#]+#[^\[\]|]+)\s*\]"
LIST_MARK = r"^(?:[-*+]\s+|[0-9]+[.)]\s+)"


def quoted(text: Column) -> Column:
    """One line, without bars and spaces at its end."""
    return F.regexp_replace(collapsed(text), "[| ]+$", "")


def row(head: Column, doc: Column, quote: Column, anchor: Column) -> Column:
    """A row; a bar in its head becomes a slash, what is empty a hyphen."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    return F.concat(F.lit("- "), F.concat_ws(" | ", some(F.replace(collapsed(head), F.lit("|"), F.lit("/"))), doc, some(quoted(quote)), anchor))


def row_fields(line: Column) -> Column:
    return F.split(F.substring(line, F.lit(3), F.length(line)), r" \| ")


def row_document(line: Column) -> Column:
    return F.coalesce(F.get(row_fields(line), F.lit(1)), F.lit(""))


def row_quote(line: Column) -> Column:
    """All between a row's document and its anchor; of a shorter row, all of it."""
    fields = row_fields(line)
    return F.when(F.size(fields) >= 4, F.array_join(F.slice(fields, F.lit(3), F.greatest(F.size(fields) - 3, F.lit(0))), " | ")).otherwise(line)


def is_quotable(line: Column) -> Column:
    return F.size(F.filter(F.split(row_quote(line), r"\s+"), lambda w: w != "")) <= QUOTABLE_WORDS


def is_table_row(quote: Column) -> Column:
    return quote.contains(" | ")


def comparison_documents(line: Column) -> Column:
    """The documents of a comparison's parts, in order."""
    return F.transform(F.split(F.substring(line, F.lit(3), F.length(line)), r" \|\| "), lambda p: F.trim(F.get(F.split(p, r" \| "), F.lit(0))))


def evidence_line(line: Column) -> Column:
    """A row as a line of the schedule, its words in quotation marks, its citation last."""
    fields = row_fields(line)
    return F.concat(F.lit("- "), F.get(fields, F.lit(0)), F.lit(' | "'), row_quote(line), F.lit('" | ['), F.get(fields, F.lit(1)), F.lit(" | "), F.element_at(fields, -1), F.lit("]"))


def comparison_line(line: Column) -> Column:
    """A comparison as one line, its parts joined by `against`."""

    def half(part: Column) -> Column:
        fields = F.split(part, r" \| ")
        doc, quote = F.get(fields, F.lit(0)), F.array_join(F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 2, F.lit(0))), " | ")
        return F.concat(doc, F.lit(' says "'), quote, F.lit('" ['), doc, F.lit(" | "), F.element_at(fields, -1), F.lit("]"))

    return F.concat(F.lit("- "), F.array_join(F.transform(F.split(F.substring(line, F.lit(3), F.length(line)), r" \|\| "), half), " against "))


def citations(text: Column) -> Column:
    """array<struct<doc, anchor>> of the citations of a text in order; a short one's document stands before its first `#`."""

    def pair(c: Column) -> Column:
        inner = F.regexp_replace(c, r"^\[\s*|\s*\]$", "")
        long = inner.contains("|")
        doc = F.when(long, F.trim(F.regexp_extract(inner, r"^([^|]*)\|", 1))).otherwise(F.regexp_extract(inner, "^([^#]*)#", 1))
        return F.struct(doc.alias("doc"), F.when(long, F.trim(F.regexp_extract(inner, r"\|(.*)$", 1))).otherwise(inner).alias("anchor"))

    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), 0), pair)


def trailing_citations(text: Column) -> Column:
    """The citations at the end of a sentence or line."""
    return citations(F.regexp_extract(F.rtrim(text), rf"((?:\s*{CITATION})+)\s*[.!?\"']*\s*$", 1))


def is_cited(sentence: Column) -> Column:
    return F.regexp_replace(sentence, r"\s*[.!?]*\s*$", "").rlike(rf"{CITATION}$")


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, " ")
