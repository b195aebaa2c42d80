"""Texts written again with other names, days, numbers and identifiers: one scan from left to right.

A scan cuts a text into what a pattern finds and the gaps between, writes each find anew by its
type, and joins them; what is written is never read again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dates import MONTHS, SHORT
from tessera.functions.text import bound

# What a scan finds, in the order in which it is tried: identifiers before days, days before numbers.
_MONTH = "|".join(sorted([*MONTHS, *SHORT], key=len, reverse=True))
KINDS = {
    "identifier": r"\b[A-Za-z][A-Za-z0-9]*(?:[-_./][A-Za-z0-9]+)+\b",
    "day": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "month": r"\b[0-9]{4}-[0-9]{2}\b",
    "written day": rf"\b[0-9]{{1,2}}\s+(?:{_MONTH})\.?\s+[0-9]{{4}}\b",
    "written month": rf"\b(?:{_MONTH})\.?\s+[0-9]{{4}}\b",
    "quarter": r"\bQ[1-4]\s*[0-9]{4}\b",
    "financial year": r"\bFY\s*[0-9]{4}\b",
    "year": r"(?<![\w.,$])(?:19|20)[0-9]{2}(?![\w%]|[.,][0-9])",
    "number": r"(?<![A-Za-z0-9.,$])(?:[$£€]\s*)?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:\s*(?:bn|m|k|%)(?![A-Za-z0-9]))?",
}
# What joins the words of a name, and runs of characters inside which no name is read.
SEPARATOR = r"[\s_-]+"
GUARDED = r"\S*[@/\\]\S*|\S*[0-9]\S*|\S*\.[A-Za-z]{2,6}(?![A-Za-z])\S*"


def scanned(text: Column, pattern: str, write: Callable[[Column], Column]) -> Column:
    """The text with every find of a pattern written anew."""

    def cut(own: Column) -> Column:
        pairs = F.zip_with(F.split(own, pattern, -1), F.regexp_extract_all(own, F.lit(pattern), 0), lambda gap, found: F.struct(gap.alias("gap"), found.alias("found")))
        return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], F.coalesce(write(p["found"]), F.lit("")))), "")

    return bound(text, cut)


def moved_day(day: Column, years: int) -> Column:
    """An ISO day so many years back; 29 February becomes the 28th where it has to.  What is no day stays."""
    return F.coalesce(F.date_format(F.add_months(F.try_to_date(day, "yyyy-MM-dd"), -12 * years), "yyyy-MM-dd"), day)


def moved_year(surface: Column, years: int) -> Column:
    """A surface whose last run of four digits is a year, so many years back."""
    shape = r"(?s)^(.*?)([0-9]{4})([^0-9]*(?:-[0-9]{2})?)$"
    part = lambda k: F.regexp_extract(surface, shape, k)
    return F.concat(part(1), (part(2).cast("int") - years).cast("string"), part(3))


def multiplied(surface: Column, factor: Decimal) -> Column:
    """A written number times a factor, to the places that it is written with (half up), with its
    commas, currency sign, scale and spaces.
    """
    shape = r"(?i)^([$£€]\s*)?([0-9][0-9,]*)(?:\.([0-9]+))?(\s*(?:bn|m|k|%))?$"
    sign, whole, decimals, scale = (F.regexp_extract(surface, shape, k) for k in (1, 2, 3, 4))
    places = F.length(decimals)
    # In units of the last place the number is whole, and so is what is written.
    units = F.concat(F.replace(whole, F.lit(","), F.lit("")), decimals).cast("decimal(30,0)")
    digits = F.lpad(F.round(units * F.lit(factor), 0).cast("decimal(38,0)").cast("string"), 38, "0")
    head = F.regexp_replace(F.substring(digits, F.lit(1), 38 - places), "^0+(?=[0-9])", "")
    grouped = F.when(whole.contains(","), F.regexp_replace(head, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")).otherwise(head)
    return F.concat(sign, grouped, F.when(places > 0, F.concat(F.lit("."), F.substring(digits, 39 - places, places))).otherwise(""), scale)


def _name_pattern(name: str) -> str:
    """A name with any separators between its words, and free spaces around an `&`."""
    return r"\s*&\s*".join(SEPARATOR.join(re.escape(word) for word in part.split()) for part in name.split("&"))


def _looked_up(found: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(found, SEPARATOR, " "), r"\s*&\s*", " & ")))


def write_names(text: Column, names: dict[str, str]) -> Column:
    """The text with every name of a table written as the other one, whatever case and separator it has.

    The replacement takes the separator (an underscore before a hyphen, these before a space) and, of a name in capitals, the capitals.
    """
    if not names:
        return text
    longest = sorted(names, key=lambda n: (-len(n), n))
    pattern = rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(map(_name_pattern, longest))})(?![A-Za-z0-9])"
    table = F.create_map(*(F.lit(x) for name, other in names.items() for x in (" & ".join(" ".join(p.split()) for p in name.split("&")).lower(), " ".join(other.split()))))

    def write(found: Column) -> Column:
        runs = F.regexp_extract_all(found, F.lit(SEPARATOR), 0)
        mark = F.when(found.contains("_"), "_").when(F.exists(runs, lambda r: r.contains("-")), "-").otherwise(F.coalesce(F.get(runs, F.lit(0)), F.lit(" ")))
        other = F.array_join(F.split(F.try_element_at(table, _looked_up(found)), " "), "\u0001")
        joined = F.replace(other, F.lit("\u0001"), mark)
        return F.coalesce(F.when((found == F.upper(found)) & found.rlike("[A-Za-z]"), F.upper(joined)).otherwise(joined), found)

    return scanned(text, pattern, write)


def rewritten(text: Column, names: dict[str, str], years: int, factor: str, suffix: str) -> Column:
    """A text as a clone of its room writes it: names first, then one scan of identifiers (a suffix), days (years back) and numbers (times a factor)."""
    whole = {kind: rf"(?i)^(?:{re.sub(r'^\(\?<!\[[^]]*\]\)', '', pattern)})$" for kind, pattern in KINDS.items()}

    def write(found: Column) -> Column:
        out = F.when(found.rlike(whole["identifier"]), F.concat(found, F.lit(suffix))).when(found.rlike(whole["day"]), moved_day(found, years))
        for kind in ("month", "written day", "written month", "quarter", "financial year", "year"):
            out = out.when(found.rlike(whole[kind]), moved_year(found, years))
        return out.otherwise(multiplied(found, Decimal(factor)))

    return scanned(write_names(text, names), "(?i)" + "|".join(KINDS.values()), write)


def respelled(text: Column, spelling: Column) -> Column:
    """A text with its names written as its document spells them.  spelling: array of struct(name, spelling).

    A name is read as a whole word, longest first, and never inside a run of characters with a
    digit, a slash or an at sign, or a host or file name.
    """
    masked = F.regexp_replace(text, GUARDED, "\ue000")
    # One alternation for all names of the document, so that no replacement is read again.
    longest = F.array_sort(spelling, lambda a, b: F.when(F.length(a["name"]) != F.length(b["name"]), F.length(b["name"]) - F.length(a["name"])).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    escaped = F.transform(longest, lambda s: F.concat(F.lit("\\Q"), s["name"], F.lit("\\E")))
    pattern = F.concat(F.lit("(?<![A-Za-z])(?:"), F.array_join(escaped, "|"), F.lit(")(?![A-Za-z])"))
    def cut(own: Column) -> Column:
        plain, table, names = own["masked"], own["table"], own["pattern"]
        pairs = F.zip_with(F.split(plain, names, -1), F.regexp_extract_all(plain, names, 0), lambda gap, found: F.struct(gap.alias("gap"), found.alias("found")))
        return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], F.coalesce(F.try_element_at(table, p["found"]), F.lit("")))), "")

    given = F.struct(masked.alias("masked"), F.map_from_entries(spelling).alias("table"), pattern.alias("pattern"))
    whole = F.when(F.size(spelling) > 0, bound(given, cut)).otherwise(masked)
    back = F.zip_with(F.split(whole, "\ue000", -1), F.regexp_extract_all(text, F.lit(GUARDED), 0), lambda gap, found: F.concat(gap, F.coalesce(found, F.lit(""))))
    return F.array_join(back, "")
