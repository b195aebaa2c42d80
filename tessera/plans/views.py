"""Views that dress the star-schema tables as rooms of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sections import lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer a document, every order a line of it: number, day, dollars, status, priority."""
    o = table(spark, sf_dir, "orders")
    cents = F.format_string("%.2f", F.col("o_totalprice"))
    text = F.concat_ws(" | ", F.concat(F.lit("ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("$"), cents), F.col("o_orderstatus"), F.col("o_orderpriority"))
    return o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("line"), text.alias("text"))


def part_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are documents that carry the parts of their line items."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.lit("identifier").alias("kind"), F.col("l_partkey").cast("string").alias("value"), F.col("l_suppkey").alias("doc")).distinct()


def daily_events(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """Sums of values per event type (or another column) and day: series, at, value."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col(by).alias("series"), F.to_date("ts").alias("at")).agg(F.round(F.sum("value"), 4).alias("value"))
