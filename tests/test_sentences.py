import pytest
from pyspark.sql import functions as F

from tessera.functions import carry
from tessera.functions.sentences import sentences


def of(spark, texts, function):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in frame.orderBy("k").select(function(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("line", "parts"),
    [
        ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
        ('It says "the end. And more. " and stops. Next.', ['It says "the end. And more. " and stops.', "Next."]),
        ("It says “stop. Go” here. Next", ["It says “stop. Go” here.", "Next"]),
        ("Invoice No. 4471 of Harborworks Inc. is due. Pay J. Marsh of the U.S. branch, e.g. today. Done.", ["Invoice No. 4471 of Harborworks Inc. is due.", "Pay J. Marsh of the U.S. branch, e.g. today.", "Done."]),
        ('- Harbor Media Inc. | "a. b" | [D | D#l1]', ['- Harbor Media Inc. | "a. b" | [D | D#l1]']),
        ("It ended. | next", ["It ended. | next"]),
        ("It cost 3.5 m.Then more.", ["It cost 3.5 m.Then more."]),
        ('An open "quote. It never ends.', ['An open "quote. It never ends.']),
        ("Casino. Nos. 4 and (no. 5) count. Tab.\tNext", ["Casino.", "Nos. 4 and (no. 5) count.", "Tab.", "Next"]),
        ("", []),
        ("  . ", ["."]),
    ],
)
def test_sentences(spark, line, parts):
    assert of(spark, [line], sentences) == [parts]


def test_normalised(spark):
    texts = ["US$12,400,000 and USD 5", "12 million, 3 Millions, 4 m", "1,234,567 and 1,2345 and 12,34", "plus$5 £3 €4", "a,b , c", "30 mm"]
    want = ["12400000 and 5", "12m, 3m, 4m", "1234567 and 1,2345 and 12,34", "plus 5 3 4", "a,b , c", "30 mm"]
    assert of(spark, texts, carry.normalised) == want


def test_sentence_numbers(spark):
    texts = ["It is 30.1% of $185,000.00, v.5 (7) DR-069 x9 8x 12m 3.", "1..2 and 4.5.6 3k, 9bn", "12 million"]
    assert of(spark, texts, carry.sentence_numbers) == [["30.1", "185000.00", "5", "7", "12", "3"], ["1", "2", "4.5.6", "3", "9"], ["12"]]
