"""Sentences of a line, told by punctuation, quotation marks and abbreviations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose full stop ends no sentence (a single letter is one too), and marks of quotations.
ABBREVIATIONS = "no nos inc ltd co corp llc vs v e.g i.e etc mr ms dr st".split()
QUOTE_MARKS = '"“”'
#: What stands for punctuation inside quotations while a line is cut.
_HIDDEN = "\ue000\ue001\ue002"


def _quotes_hidden(line: Column) -> Column:
    """The line with other characters for the full stops, exclamation and question marks of its quotations."""
    parts = F.regexp_extract_all(line, F.lit(f"[^{QUOTE_MARKS}]+|[{QUOTE_MARKS}]"), 0)
    mark = lambda p: p.isin(*QUOTE_MARKS)
    said = lambda s, p: F.concat(s["text"], F.when(s["quoted"], F.translate(p, ".!?", _HIDDEN)).otherwise(p))
    step = lambda s, p: F.when(mark(p), F.struct((~s["quoted"]).alias("quoted"), F.concat(s["text"], p).alias("text"))).otherwise(F.struct(s["quoted"].alias("quoted"), said(s, p).alias("text")))
    return F.aggregate(parts, F.struct(F.lit(False).alias("quoted"), F.lit("").alias("text")), step, lambda s: s["text"])


def sentences(line: Column) -> Column:
    """The sentences of a line in order.

    One ends at a full stop, exclamation or question mark before white space, but not inside a
    quotation, not before a `|`, and not at an abbreviation's or initial's full stop.
    """
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    end = rf"(?i)(?<=[.!?])(?<!(?:^|[\s(\['.{QUOTE_MARKS}])(?:{short}|[a-z])\.)(?=\s)(?!\s*\|)"
    parts = F.transform(F.split(_quotes_hidden(line), end), lambda p: F.translate(F.regexp_replace(p, r"^\s+|\s+$", ""), _HIDDEN, ".!?"))
    return F.filter(parts, lambda p: p != "")
