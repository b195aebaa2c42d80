"""Days and periods that texts name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound

# Months as they are written.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
_NAMES = "|".join(sorted([*MONTHS, *SHORT], key=len, reverse=True))
_ISO = r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
_DAY_FIRST = rf"\b[0-9]{{1,2}}\s+(?i:{_NAMES})\.?,?\s+[0-9]{{4}}\b"
_MONTH_FIRST = rf"\b(?i:{_NAMES})\.?\s+[0-9]{{1,2}},\s*[0-9]{{4}}\b"
WRITTEN_DAY = f"{_ISO}|{_DAY_FIRST}|{_MONTH_FIRST}"


def _month(name: Column) -> Column:
    numbers = {m: k for k, m in enumerate(MONTHS, 1)} | SHORT
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in numbers.items() for x in kv)), F.lower(name))


def _day(year: Column, month: Column, day: Column) -> Column:
    """An ISO day, null if the calendar lacks it."""
    return F.date_format(F.try_to_date(F.format_string("%s-%02d-%02d", year, month, day.try_cast("int")), "yyyy-MM-dd"), "yyyy-MM-dd")


def iso_of(surface: Column) -> Column:
    """The ISO day of one written day; else null."""
    part = lambda pattern, k: F.regexp_extract(surface, pattern, k)
    iso, dmy, mdy = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{1,2})\s+([A-Za-z]+)\.?,?\s+([0-9]{4})$", r"^([A-Za-z]+)\.?\s+([0-9]{1,2}),\s*([0-9]{4})$"
    return (
        F.when(surface.rlike(iso), _day(part(iso, 1), part(iso, 2).try_cast("int"), part(iso, 3)))
        .when(surface.rlike(dmy), _day(part(dmy, 3), _month(part(dmy, 2)), part(dmy, 1)))
        .when(surface.rlike(mdy), _day(part(mdy, 3), _month(part(mdy, 1)), part(mdy, 2)))
    )


def days_in(text: Column) -> Column:
    """The days that a text names, as ISO strings in order, with repeats."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(WRITTEN_DAY), 0), iso_of), lambda d: d.isNotNull())


def first_day(text: Column) -> Column:
    return F.get(days_in(text), F.lit(0))


def cut_days(text: Column) -> Column:
    """The text with a space for every day it names."""
    # Days that the calendar lacks stay, so each written day is replaced by itself or a space.
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(WRITTEN_DAY), 0), lambda s: iso_of(s).isNotNull()))
    return F.aggregate(found, text, lambda t, s: F.replace(t, s, F.lit(" ")))


def mask_days(text: Column) -> Column:
    """The text with as many spaces as each day it names is long, so that places stay."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(WRITTEN_DAY), 0), lambda s: iso_of(s).isNotNull()))
    return F.aggregate(found, text, lambda t, s: F.replace(t, s, F.repeat(F.lit(" "), F.length(s))))


def period(surface: Column) -> Column:
    """struct(grain, y, p, d) of a cell that names a day, a month or a quarter; else null."""
    month, named = r"^([0-9]{4})-(0[1-9]|1[0-2])$", rf"^((?i:{'|'.join(MONTHS)}))\s+([0-9]{{4}})$"
    year_first, quarter_first = r"(?i)^(?:FY)?([0-9]{4})[ _-]?Q([1-4])$", r"(?i)^Q([1-4])[ _-]?(?:FY)?([0-9]{4})$"
    made = lambda grain, y, p, d: F.struct(F.lit(grain).alias("grain"), y.alias("y"), p.alias("p"), d.alias("d"))

    text = F.trim(surface.cast("string"))
    part = lambda pattern, k: F.regexp_extract(text, pattern, k).try_cast("int")
    # A day with a time is cut to the day; others are read as written.  The first are plain numbers of a day that the calendar has.
    number = lambda source, at, n: F.substring(source, at, n).try_cast("int")
    days = lambda source: made("day", number(source, 1, 4), number(source, 6, 2), number(source, 9, 2))
    iso = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ].*)?$")
    known = F.substring(text, 1, 10).try_cast("date").isNotNull() & (F.substring(text, 1, 4) != "0000")
    worded = text.rlike(rf"^[0-9]{{1,2}}\s+(?i:{'|'.join(MONTHS)})\s+[0-9]{{4}}$")
    return (
        F.when(iso, F.when(known, days(text)))
        .when(text.rlike(month), made("month", part(month, 1), part(month, 2), F.lit(0)))
        .when(worded, bound(iso_of(text), lambda day: F.when(day.isNotNull(), days(day))))
        .when(text.rlike(named), made("month", part(named, 2), _month(F.regexp_extract(text, named, 1)), F.lit(0)))
        .when(text.rlike(year_first), made("quarter", part(year_first, 1), part(year_first, 2), F.lit(0)))
        .when(text.rlike(quarter_first), made("quarter", part(quarter_first, 2), part(quarter_first, 1), F.lit(0)))
    )


def period_text(p: Column) -> Column:
    return F.when(p["grain"] == "day", F.format_string("%04d-%02d-%02d", p["y"], p["p"], p["d"])).when(p["grain"] == "month", F.format_string("%04d-%02d", p["y"], p["p"])).when(p["grain"] == "quarter", F.format_string("%04d-Q%d", p["y"], p["p"]))


def step_between(before: Column, after: Column) -> Column:
    """week, month or quarter from one period to the next of the same grain; else null."""
    days = F.datediff(F.make_date(after["y"], after["p"], after["d"]), F.make_date(before["y"], before["p"], before["d"]))
    months, quarters = (after["y"] - before["y"]) * 12 + after["p"] - before["p"], (after["y"] - before["y"]) * 4 + after["p"] - before["p"]
    grain = F.when(before["grain"] == after["grain"], before["grain"])
    return F.when((grain == "day") & (F.when(grain == "day", days) == 7), "week").when((grain == "month") & (months == 1), "month").when((grain == "month") & (months == 3), "quarter").when((grain == "quarter") & (quarters == 1), "quarter")


def name_period(path: Column) -> Column:
    """struct(before, after, stem, period) of a path that names a month or a quarter; else null."""
    out = F.lit(None)
    for grain, pattern, year, part in (
        ("quarter", r"(?i)(?s)^(.*?)(?<![A-Za-z0-9])Q([1-4])[_-]([0-9]{4})(?![0-9])(.*)$", 3, 2),
        ("quarter", r"(?i)(?s)^(.*?)(?<![0-9])([0-9]{4})[_-]Q([1-4])(?![0-9])(.*)$", 2, 3),
        ("month", r"(?s)^(.*?)(?<![0-9])([0-9]{4})[_-](0[1-9]|1[0-2])(?![0-9])(.*)$", 2, 3),
    ):
        at = lambda k: F.regexp_extract(path, pattern, k)  # noqa: B023, E731
        stem = F.regexp_replace(F.element_at(F.split(at(1), "/"), -1), "[_. -]+$", "")
        own = F.struct(F.lit(grain).alias("grain"), at(year).try_cast("int").alias("y"), at(part).try_cast("int").alias("p"), F.lit(0).alias("d"))
        out = F.when(path.rlike(pattern), F.struct(at(1).alias("before"), at(4).alias("after"), stem.alias("stem"), own.alias("period"))).otherwise(out)
    return out
