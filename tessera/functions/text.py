"""Column functions on text.  Patterns avoid lookbehind, so that they mean the same in SQL engines without it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
IDENTIFIER = r"\b[A-Za-z][A-Za-z0-9]*(?:[-_./][A-Za-z0-9]+)+\b"
CAPITALISED = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}"
NUMBERED_HEADING = r"^[0-9]+(?:\.[0-9]+)*\.? +[A-Z]"
ISO_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
MONEY = r"\$[0-9][0-9,]*(?:\.[0-9]+)?"
PLAIN_NUMBER = r"^-?[0-9][0-9,]*(?:\.[0-9]+)?$"

# Words that carry no content, for overlap counts.
COMMON_WORDS = tuple(
    """a an and any are as at be been by can could for from had has have he her his in is it its may no not of on or our she should that the their them there they this to us was we were what which will with would""".split()
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body names it: within the
    lambda of an array function an outer expression is evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapsed(text: Column) -> Column:
    """Runs of white space become one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-case ASCII words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def content_words(text: Column) -> Column:
    """Distinct words of three letters or more that are not common ones."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) >= 3) & ~w.isin(*COMMON_WORDS)))


def is_count(value: Column) -> Column:
    """Digits and commas only, after trimming."""
    return F.trim(value).rlike("^[0-9][0-9,]*$")


def number_of(text: Column) -> Column:
    """The number that a whole field writes, thousands commas allowed; else null."""
    return F.when(text.rlike(PLAIN_NUMBER), F.replace(text, F.lit(","), F.lit("")).cast("double"))


def money_value(text: Column) -> Column:
    """Dollars of a `$1,234.50` surface; else null."""
    return F.when(text.rlike(f"^{MONEY}$"), F.regexp_replace(text, "[$,]", "").cast("double"))


def line_anchor(doc: Column, line: Column) -> Column:
    """`doc#l<line>`."""
    return F.concat(doc.cast("string"), F.lit("#l"), line.cast("string"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def scaled_value(surface: Column) -> Column:
    """A number with an optional scale letter or word (k, m, mn, bn, thousand, million, billion); else null."""
    at = lambda g: F.regexp_extract(F.lower(F.trim(surface)), r"^\$?([0-9][0-9,]*(?:\.[0-9]+)?) ?(k|m|mn|bn|thousand|million|billion)?$", g)
    scale = F.when(at(2).isin("k", "thousand"), 1e3).when(at(2).isin("m", "mn", "million"), 1e6).when(at(2).isin("bn", "billion"), 1e9).otherwise(1.0)
    return F.when(at(1) != "", F.replace(at(1), F.lit(","), F.lit("")).cast("double") * scale)


# Units and scales as written.
_AMOUNT = r"^(?:[a-z][a-z -]* \()?([$])?([0-9][0-9,]*(?:[.][0-9]+)?)\)?[ -]?(k|m|mn|bn|thousand|million|billion)?[ -]?(%|percent|records?|months?|days?)?$"


def amount(surface: Column) -> Column:
    """struct(value, unit) of a written amount: USD, percent, records, months, days or no unit; null if it is none."""
    at = lambda g: F.regexp_extract(F.lower(F.trim(surface)), _AMOUNT, g)
    scale = F.when(at(3).isin("k", "thousand"), 1e3).when(at(3).isin("m", "mn", "million"), 1e6).when(at(3).isin("bn", "billion"), 1e9).otherwise(1.0)
    unit = F.when(at(1) == "$", "USD").when(at(4).isin("%", "percent"), "percent").when(at(4) != "", F.concat(F.regexp_replace(at(4), "s$", ""), F.lit("s")))
    return F.when(at(2) != "", F.struct((F.replace(at(2), F.lit(","), F.lit("")).cast("double") * scale).alias("value"), unit.alias("unit")))


# Scale words of column headers.
_SCALES = {"b": 1e9, "billion": 1e9, "billions": 1e9, "bn": 1e9, "m": 1e6, "million": 1e6, "millions": 1e6, "mm": 1e6, "k": 1e3, "thousand": 1e3, "thousands": 1e3, "000": 1e3, "000s": 1e3}


def header_scale(header: Column) -> Column:
    """What a column header multiplies its figures by: the first scale word in brackets or right
    after a dollar sign, `($M)`, `(USD bn)`, `$000s`; else 1.
    """
    places = F.regexp_extract_all(F.lower(header), F.lit(r"\(([^()]*)\)|\$([a-z0-9]+)"), 0)
    tokens = F.flatten(F.transform(places, lambda p: F.regexp_extract_all(p, F.lit("[a-z]+|[0-9]+s?"), 0)))
    scales = F.create_map(*(F.lit(x) for kv in _SCALES.items() for x in kv))
    return F.coalesce(F.get(F.filter(F.transform(tokens, lambda t: F.try_element_at(scales, t)), lambda x: x.isNotNull()), F.lit(0)), F.lit(1.0))


def header_unit(header: Column) -> Column:
    """The unit that a column header names: USD, percent, records, months, days; else null."""
    h = F.lower(header)
    return F.when(h.rlike(r"\$|usd"), "USD").when(h.rlike("%|percent"), "percent").when(h.contains("record"), "records").when(h.contains("month"), "months").when(h.contains("day"), "days")


def following_unit(after: Column) -> Column:
    """The unit among the first three words behind a number, up to a bracket, comma, semicolon, bar, tab or digit."""
    words_ = F.slice(F.regexp_extract_all(F.regexp_extract(F.substring(after, 1, 60), r"^[^(),;|\t0-9]*", 0), F.lit("[A-Za-z]+"), 0), 1, 3)
    units = F.transform(words_, lambda w: F.regexp_replace(F.lower(w), "s+$", ""))
    named = F.filter(units, lambda u: u.isin("record", "month", "day", "percent"))
    first = F.get(named, F.lit(0))
    return F.when(first == "percent", first).otherwise(F.concat(first, F.lit("s")))


def context(text: Column) -> Column:
    """The first 240 characters of a text on one line."""
    return F.substring(collapsed(text), 1, 240)


def day(surface: Column) -> Column:
    """The day that a text writes, in ISO form with or without a time, or with an English month; else null."""
    text = F.trim(surface)
    iso = F.try_to_date(F.regexp_extract(text, rf"^\[?({ISO_DAY})(?:[T ][^\]]*)?\]?$", 1), "yyyy-MM-dd")
    plain = F.regexp_replace(text, r"^([A-Za-z]+) ([0-9]{1,2}), ([0-9]{4})$", "$2 $1 $3")
    named = F.when(plain.rlike(r"^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$"), plain)
    return F.coalesce(iso, F.try_to_date(named, "d MMMM yyyy"), F.try_to_date(named, "d MMM yyyy"))


def word_runs(text: Column, n: int) -> Column:
    """The distinct runs of n content words in order, joined by spaces."""
    kept = F.filter(words(text), lambda w: (F.length(w) >= 3) & ~w.isin(*COMMON_WORDS))
    runs = kept
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(kept, k + 1, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(runs, lambda r: r.isNotNull()))
