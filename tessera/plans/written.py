"""Queries on reports, dossiers and variants written from the tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rewriting import rewritten
from tessera.operators import digest, repair, report_checks
from tessera.plans.catalog import query
from tessera.plans.views import order_rows, table


def _c(key: str) -> Column:
    return F.concat(F.lit("C"), F.col(key).cast("string"))


def _thousands() -> Column:
    return F.round(F.col("o_totalprice") / 1000).cast("long").cast("string")


def _customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment", "c_acctbal")
    return table(spark, sf_dir, "orders").join(c, "o_custkey")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each nation's urgent open orders, a line of three sentences each: doc, line, text."""
    o = _customer_orders(spark, sf_dir).where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    key = F.col("o_orderkey").cast("string")
    said = F.concat(
        F.lit("1. Order ORD-"), key, F.lit(' of "Acme. Inc" cost $'), _thousands(), F.lit("k, says J. Doe. It left on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("! See No. 7 ["), _c("o_custkey"), F.lit(" | "), _c("o_custkey"), F.lit(".md#l"), key, F.lit("].")
    )
    doc = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    heads = o.select(doc.alias("doc")).distinct().select("doc", F.explode(F.array(F.struct(F.lit(0).alias("line"), F.lit("# Report").alias("text")), F.struct(F.lit(1).alias("line"), F.lit("## Findings").alias("text")))).alias("x"))
    return heads.select("doc", F.col("x.line").cast("long").alias("line"), "x.text").unionByName(o.select(doc.alias("doc"), (F.col("o_orderkey") + 2).cast("long").alias("line"), said.alias("text")))


_WRITTEN = """o as (select *, 'N' || c_nationkey doc, 'C' || o_custkey cust, 'C' || o_custkey || '.md#l' || o_orderkey anchor, round(o_totalprice / 1000)::bigint::varchar thousands,
  strftime(o_orderdate, '%-d %B %Y') said_day, strftime(o_orderdate, '%Y-%m-%d') as iso, o_orderkey + 2 line from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT' and o_orderstatus = 'P'),
s as (select *, unnest([1, 2, 3]) n, unnest(['Order ORD-' || o_orderkey || ' of "Acme. Inc" cost $' || thousands || 'k, says J. Doe.', 'It left on ' || said_day || '!', 'See No. 7 [' || cust || ' | ' || anchor || '].']) said from o)"""


@query(f"with {_WRITTEN} select doc, line, n::int as position, said as text, anchor from s")
def q75_cited_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the reports with the one citation that covers each."""
    found = report_checks.cited_sentences(reports(spark, sf_dir))
    return found.select("doc", "line", F.col("at").alias("position"), "text", F.array_join("cites.anchor", ",").alias("anchor"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of orders below 300,000 dollars."""
    o = table(spark, sf_dir, "orders").where("o_totalprice < 300000")
    text = F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string"), F.lit(" paid $"), _thousands(), F.lit("k on "), F.date_format("o_orderdate", "d MMMM yyyy"))
    return o.select(F.concat(_c("o_custkey"), F.lit(".md#l"), F.col("o_orderkey").cast("string")).alias("anchor"), text.alias("text"), F.lit(None).cast("array<string>").alias("cells"))


@query(f"""with {_WRITTEN}
select doc, line, 'the sentence ends in no citation' reason, 2 as n from o union all select doc, line, anchor || ' is no section of the room', 1 from o where o_totalprice >= 300000
union all select doc, line, cust || '.md is on no record of the index', 1 from o where c_acctbal < 0 union all select doc, line, cust || ' is D' || o_custkey || '.md, not ' || cust || '.md', 1 from o where c_nationkey = 3""")
def q76_check_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the reports against the places of cheaper orders, an index of customers in credit, and a map that has one nation's paths wrong."""
    c = table(spark, sf_dir, "customer")
    indexed = c.where("c_acctbal >= 0").select(F.concat(_c("c_custkey"), F.lit(".md")).alias("doc"))
    mapping = c.select(_c("c_custkey").alias("doc"), F.concat(F.when(F.col("c_nationkey") == 3, "D").otherwise("C"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"))
    found = report_checks.check_citations(reports(spark, sf_dir), _sections(spark, sf_dir), indexed, mapping)
    return found.groupBy("doc", "line", "reason").agg(F.count("*").cast("int").alias("n"))


@query(f"""with {_WRITTEN}, k as (
  select doc, line, thousands as value from o where o_totalprice >= 300000 union all select doc, line, iso from o where o_totalprice >= 300000
  union all select doc, line, '7' from o where o_totalprice >= 300000 or not (o_orderkey = 7 or thousands = '7'))
select doc, line, value || ' is in no cited section' reason, count(*)::int n from k group by all""")
def q77_check_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and days of the reports that the places they cite do not write."""
    found = report_checks.check_numbers(reports(spark, sf_dir), _sections(spark, sf_dir))
    return found.groupBy("doc", "line", "reason").agg(F.count("*").cast("int").alias("n"))


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dossier of each nation, open orders its second matter: dossier, matter, section, place, line."""
    o = _customer_orders(spark, sf_dir).withColumn("matter", F.when(F.col("o_orderstatus") == "P", 2).otherwise(1)).withColumn("dossier", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    place, anchor = F.col("o_orderkey").cast("int"), F.concat(_c("o_custkey"), F.lit(".md#l"), F.col("o_orderkey").cast("string"))
    line = lambda head, quote: F.concat(F.lit("- "), F.concat_ws(" | ", head, _c("o_custkey"), quote, anchor))
    price = F.concat(F.lit("$"), _thousands(), F.lit("k"))
    rows = lambda df, section, text: df.select("dossier", "matter", F.lit(section).alias("section"), place.alias("place"), text.alias("line"))
    paid = F.concat(price, F.lit(" paid"))
    urgent = o.where("o_orderpriority = '1-URGENT'")
    out = rows(o, "Timeline", line(F.date_format("o_orderdate", "yyyy-MM-dd"), paid)).unionByName(rows(o, "Figures", line(price, paid)))
    out = out.unionByName(rows(urgent, "Names", line(F.col("c_mktsegment"), paid))).unionByName(rows(o.where("c_acctbal < 0 and o_orderpriority = '2-HIGH'"), "Lesser matters", line(price, paid)))
    return out


@query("""with o as (select *, 'N' || c_nationkey dossier, case when o_orderstatus = 'P' then 2 else 1 end matter from orders join customer on c_custkey = o_custkey),
w as (select distinct dossier, matter, o_custkey from o where o_orderpriority = '1-URGENT'),
k as (select dossier, matter, count(distinct c_mktsegment) filter (o_orderpriority = '1-URGENT') n_names from o group by all),
ls as (select o.dossier, o.matter, o.o_custkey, row_number() over (partition by o.dossier order by o_orderkey) r from o where matter = 1 and c_acctbal < 0 and o_orderpriority = '2-HIGH'),
le as (select dossier, matter, count(*) n_lesser from ls where r <= 6 or not exists (select 1 from w where w.dossier = ls.dossier and w.matter = ls.matter and w.o_custkey = ls.o_custkey) group by all),
n as (select dossier, matter, count(*) n_weighed from w group by all), av as (select o.dossier, o.matter, count(*) available from o join w using (dossier, matter, o_custkey) group by all),
r as (select k.*, coalesce(n_weighed, 0) n_weighed, coalesce(n_lesser, 0) n_lesser, coalesce(available, 0) available, greatest(case when matter = 1 then 150 else 45 end - n_names - least(6, coalesce(n_lesser, 0)), 0) room
  from k left join le using (dossier, matter) left join n using (dossier, matter) left join av using (dossier, matter)),
t as (select *, least(available, room, greatest(n_weighed, least(60, room * 2 // 3))) n_timeline from r),
x as (select dossier, matter, unnest(['Timeline', 'Names', 'Figures', 'Lesser matters']) section, unnest([n_timeline, n_names, least(available, 40, greatest(room - n_timeline, 0)), n_lesser]) n from t)
select dossier, matter, section, n from x where n > 0""")
def q78_digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each section the digests keep: 150 of a first matter, its lesser rows beyond six apart, and 45 of a second."""
    return digest.digest(dossiers(spark, sf_dir)).groupBy("dossier", "matter", "section").agg(F.count("*").alias("n"))


@query("""with l as (select o_custkey report, o_orderkey k, o_orderstatus st, case o_orderstatus when 'F' then 'done' else 'open' end word from orders)
select report, '## Lesser issues' || chr(10) || coalesce(string_agg('1. Order ORD-' || k || ' is ' || word || '.' || chr(10), '' order by k) filter (st <> 'P'), '') as text from l group by report""")
def q79_report_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each customer's orders, in which done ones are said to be done and open ones are taken out."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("n"), "o_orderstatus")
    said = lambda word: F.concat(F.lit("Order ORD-"), F.col("n").cast("string"), F.lit(f" is {word}."))
    listed = o.select("report", "n", said("open").alias("sentence"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n", "sentence"))), lambda x: F.concat(F.lit("1. "), x["sentence"], F.lit("\n")))
    texts = listed.groupBy("report").agg(F.concat(F.lit("## Lesser issues\n"), F.array_join(lines, "")).alias("text"))
    fixes = o.where("o_orderstatus <> 'O'").select("report", F.col("n").alias("at"), "n", F.when(F.col("o_orderstatus") == "F", said("done")).otherwise("").alias("sentence"))
    return repair.apply_fixes(texts, listed, fixes)


@query("""select o_custkey doc, o_orderkey line, concat_ws(' | ', 'ORD-' || lpad(o_orderkey::varchar, 6, '0') || '-AB', strftime(o_orderdate - interval 7 year, '%Y-%m-%d'), '$' || round(o_totalprice::decimal(18, 2) * 1.7, 2)::decimal(18, 2),
  o_orderstatus, (split_part(o_orderpriority, '-', 1)::int * 1.7).round()::int || '-' || case when o_orderpriority = '4-NOT SPECIFIED' then 'NEVER SAID' else split_part(o_orderpriority, '-', 2) end) as text from orders""")
def q80_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order rows as a clone of the room writes them: other names, days seven years back, numbers grown, identifiers marked."""
    return order_rows(spark, sf_dir).select("doc", "line", rewritten(F.col("text"), {"not specified": "never said"}, 7, "1.7", "-AB").alias("text"))
