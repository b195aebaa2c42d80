"""Queries of the typed index: reports written from the orders, and tables written as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import links, typed_index
from tessera.plans.catalog import query
from tessera.plans.views import table


def _sections(rows: DataFrame) -> DataFrame:
    """Text sections from doc, ordinal, text."""
    anchor = F.concat("doc", F.lit("#l"), F.col("ordinal").cast("string"))
    return rows.select("doc", F.col("ordinal").cast("long").alias("ordinal"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("heading"), anchor.alias("anchor"), "text", F.lit(None).cast("array<struct<ref: string, value: string, number: double>>").alias("cells"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each nation and month, with a line for each order.

    Reports of even months are drafts; one of an odd month is final and replaces the first order of the month before.
    """
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
    o = o.withColumn("month", F.trunc("o_orderdate", "month"))
    name = lambda month: F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("/Report_"), F.date_format(month, "yyyy_MM"), F.lit(".md"))
    written = lambda day: F.date_format(day, "d MMMM yyyy")
    heads = o.groupBy("c_nationkey", "month").agg(F.min("o_orderdate").alias("day"), F.min("o_orderkey").alias("k"))
    w = Window.partitionBy("c_nationkey").orderBy("month")
    heads = heads.withColumn("old", F.when(F.lag("month").over(w) == F.add_months("month", -1), F.lag("k").over(w))).withColumn("even", F.month("month") % 2 == 0)
    front = F.concat_ws("\n", F.concat(F.lit("Status "), F.when(F.col("even"), "Draft").otherwise("Final")), F.concat(F.lit("Date "), written("day")), F.when(~F.col("even"), F.concat(F.lit("Replaces ORD-"), F.col("old").cast("string"))))
    said = F.concat_ws(
        " ", F.lit("We ship"), F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")), F.lit("on"), written("o_orderdate"), F.lit("for"),
        F.concat(F.lit("$"), F.round(F.col("o_totalprice") / 1000).cast("long").cast("string"), F.lit("k")), F.lit("within"), (F.col("c_nationkey") + 2).cast("string"), F.lit("days at"), F.initcap("c_mktsegment"), F.lit("Group."),
    )
    rows = heads.select(name("month").alias("doc"), F.lit(0).cast("long").alias("ordinal"), front.alias("text"))
    return _sections(rows.unionByName(o.select(name("month").alias("doc"), (F.col("o_orderkey") + 1).cast("long").alias("ordinal"), said.alias("text"))))


_REPORTS = """o as (select *, date_trunc('month', o_orderdate)::date as month, 'N' || c_nationkey || '/Report_' || strftime(o_orderdate, '%Y_%m') || '.md' doc,
  upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) seg from orders join customer on c_custkey = o_custkey),
h as (select c_nationkey, month, doc, min(o_orderdate)::date as day, min(o_orderkey) k, extract(month from month) % 2 = 0 even from o group by all),
g as (select h.*, p.k old, p.doc old_doc, p.day old_day from h left join h p on p.c_nationkey = h.c_nationkey and p.month = h.month - interval 1 month),
said as (
  select 'date' kind, strftime(o_orderdate, '%Y-%m-%d') as value, null unit, doc from o union all select 'date', strftime(day, '%Y-%m-%d'), null, doc from g
  union all select 'amount', (round(o_totalprice / 1000)::bigint * 1000)::varchar, 'USD', doc from o union all select 'amount', (c_nationkey + 2)::varchar, 'days', doc from o
  union all select 'identifier', 'ORD-' || o_orderkey, null, doc from o union all select 'identifier', 'ORD-' || old, null, doc from g where not even and old is not null
  union all select 'status', case when even then 'draft' else 'final' end, null, doc from g
  union all select 'version-pair', old_doc || ' -> ' || doc, null, unnest([old_doc, doc]) from g where not even and old is not null
  union all select 'series', 'month documents N' || c_nationkey || '/Report_*.md', null, unnest(list(doc)) from g group by c_nationkey having count(*) >= 2 and datediff('month', min(month), max(month)) = count(*) - 1
  union all select 'name', unnest(['Status ' || s, 'Status ' || s || ' Date', s || ' Date']), null, doc from (select *, case when even then 'Draft' else 'Final' end s from g)
  union all select 'name', 'Replaces ORD', null, doc from g where not even and old is not null
  union all select 'name', seg || ' Group', null, doc from o),
w as (
  select unnest(['ORD', strftime(o_orderdate, '%B'), seg, 'Group']) as value, doc from o where strftime(o_orderdate, '%B') <> '' union all select case when even then 'Draft' else 'Final' end, doc from g
  union all select strftime(day, '%B'), doc from g union all select 'ORD', doc from g where not even and old is not null)
"""


@query(f"""with {_REPORTS}, every as (select * from said union all select 'name', value, null, doc from w where value in (select value from w group by value having count(distinct doc) > 1))
select kind, value, coalesce(unit, '') unit, count(*) n, count(distinct doc) n_docs from every group by all""")
def q72_typed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all seven kinds of the reports."""
    found = typed_index.records(typed_index.build_index(reports(spark, sf_dir)))
    return found.select("kind", "value", F.coalesce("unit", F.lit("")).alias("unit"), "n", "n_docs")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as lines: events of a user by week, orders of a nation and of a customer by month, line items of a supplier by quarter."""
    o = table(spark, sf_dir, "orders").withColumn("at", F.trunc("o_orderdate", "month"))
    nations = o.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    events = table(spark, sf_dir, "events").withColumn("at", F.to_date(F.date_trunc("week", "ts")))
    items = table(spark, sf_dir, "lineitem").withColumn("at", F.trunc("l_shipdate", "quarter"))

    def lines(rows: DataFrame, prefix: str, key: str, head: str, value: Column, period: Column) -> DataFrame:
        """A row for each key and period, and a header for each key: keys are counted as they are, and named last."""
        doc = F.concat(F.lit(prefix), F.col(key).cast("string")).alias("doc")
        own = rows.groupBy(key, "at").agg(F.count("*").alias("n"), F.sum(value.cast("long")).alias("total"))
        text = F.concat_ws(" | ", period, F.col("n").cast("string"), F.col("total").cast("string"))
        return own.select(doc, F.unix_date("at").alias("ordinal"), text.alias("text")).unionByName(rows.select(key).distinct().select(doc, F.lit(0).alias("ordinal"), F.lit(f"{head} | Rows | Total ($)").alias("text")))

    month, dollars = F.date_format("at", "yyyy-MM"), F.round("o_totalprice")
    quarter = F.concat(F.lit("Q"), F.quarter("at").cast("string"), F.lit(" "), F.year("at").cast("string"))
    parts = [
        lines(events, "week", "user_id", "Week", F.round("value"), F.date_format("at", "yyyy-MM-dd")),
        lines(nations, "nation", "c_nationkey", "Month", dollars, month),
        lines(o, "customer", "o_custkey", "Month", dollars, month),
        lines(items, "quarter", "l_suppkey", "Quarter", F.col("l_quantity"), quarter),
    ]
    return _sections(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


_TABLES = """p as (
  select 'week' || user_id doc, 'Week' surface, date_trunc('week', ts)::date as began, count(*) n, sum(round(value)::bigint) total from events group by all
  union all select 'nation' || c_nationkey, 'Month', date_trunc('month', o_orderdate)::date, count(*), sum(round(o_totalprice)::bigint) from orders join customer on c_custkey = o_custkey group by all
  union all select 'customer' || o_custkey, 'Month', date_trunc('month', o_orderdate)::date, count(*), sum(round(o_totalprice)::bigint) from orders group by all
  union all select 'quarter' || l_suppkey, 'Quarter', date_trunc('quarter', l_shipdate)::date, count(*), sum(l_quantity::bigint) from lineitem group by all),
k as (select *, lag(began) over (partition by doc order by began) was from p),
s as (select *, case when was is null then null when surface = 'Week' and began = was + 7 then 'week' when surface = 'Month' and datediff('month', was, began) = 1 then 'month'
  when surface in ('Month', 'Quarter') and datediff('month', was, began) = 3 then 'quarter' else 'none' end step from k),
r as (select doc, surface, min(step) step, count(*) n, min(began) a, max(began) b from s group by all having count(*) >= 3 and min(step) = max(step) and min(step) <> 'none'),
t as (select *, case surface when 'Week' then strftime(a, '%Y-%m-%d') when 'Month' then strftime(a, '%Y-%m') else year(a) || '-Q' || quarter(a) end as "first",
  case surface when 'Week' then strftime(b, '%Y-%m-%d') when 'Month' then strftime(b, '%Y-%m') else year(b) || '-Q' || quarter(b) end as "last" from r)"""


@query(f"""with {_TABLES} select doc, 'c1' as "column", step, n, "first", "last", surface from t""")
def q73_row_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the tables that step by one week, month or quarter, under their headers."""
    sections = _tables(spark, sf_dir)
    return typed_index.row_series(sections, links.written(typed_index.line_tables(sections), "line-tables")).select("doc", "column", "step", "n", "first", "last", "surface")


@query(f"""with {_TABLES}, c as (select p.doc, began, unnest(['c2', 'c3']) as "column", unnest([p.n, total])::double as value from p join r using (doc) where p.surface = 'Week')
select doc, "column", count(*) n, min(began) as "first", sum(value)::double total from c group by all""")
def q74_series_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose rows begin with days, read back as numbers."""
    found = typed_index.series_numbers(_tables(spark, sf_dir))
    return found.groupBy("doc", "column").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum("value").alias("total"))
