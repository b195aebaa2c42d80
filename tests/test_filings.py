from pyspark.sql import functions as F

from tessera.operators import filings
from tests.test_functions import of
from tests.test_links import rows


def test_headings(spark):
    lines = ["Item 1A. Risk Factors", "**ARTICLE IV**", "| Item 7 | 12 |", "| Item 7 | Text |", "| ALL CAPS |", "RISKS AND MORE", "ABC", "Mixed CASE", "---", "Part II", "X" * 151, "Itemised"]
    assert of(spark, lines, filings.heading) == ["Item 1A. Risk Factors", "ARTICLE IV", None, "Item 7 Text", None, "RISKS AND MORE", None, None, None, "Part II", None, None]


def split(spark, text, limit=40_000):
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(text.split("\n"))], "doc string, line int, text string")
    return [(r["file"], r["heading"], r["text"]) for r in filings.split_filings(lines, limit).orderBy("number").collect()]


def test_parts_are_folded(spark):
    text = "Intro\n\nCOVER PAGE\n\nITEM ONE\n---\nItem 1. Business\nWe sell.\n\nItem 2. Empty"
    assert split(spark, text) == [("01-front-matter.md", "front matter", "Intro\n"), ("02-item-1-business.md", "Item 1. Business", "COVER PAGE\nITEM ONE\n---\nItem 1. Business\nWe sell.\nItem 2. Empty\n")]
    assert split(spark, "COVER PAGE\nSIGNATURES") == [("01-front-matter.md", "front matter", "COVER PAGE\nSIGNATURES\n")]


def test_long_parts_keep_every_character(spark):
    text = "Item 1\n" + "\n\n".join(" ".join(f"word{k}{j}" for j in range(9)) + "\nsecond line" for k in range(12)) + "\n\n" + "y" * 500 + "\nend"
    got = split(spark, text, 200)
    assert "".join(t for _, _, t in got) == text + "\n" and all(len(t) <= 200 for _, _, t in got) and [h for _, h, _ in got][:2] == ["Item 1", "Item 1 (continued 2)"]
    assert rows(filings.parts(spark.createDataFrame([("d", 0, "  ")], "doc string, line int, text string")), "doc") == []
    assert of(spark, ["a"], lambda c: F.upper(c)) == ["A"]
