"""Queries on notes, comparisons, dossier rows and recall over the tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import choices, digest, dossier, dossier_text, links, notes, report, typed_index, variants, verify
from tessera.plans.catalog import query
from tessera.plans.views import table
from tessera.plans.written import dossiers


def _key() -> Column:
    return F.col("o_orderkey").cast("string")


def _price() -> Column:
    return F.concat(F.lit("$"), F.round(F.col("o_totalprice") / 1000).cast("long").cast("string"), F.lit("k"))


def _status(f: Column, o: Column, p: Column) -> Column:
    return F.when(F.col("o_orderstatus") == "F", f).when(F.col("o_orderstatus") == "O", o).otherwise(p)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as sections, some words of them emphasised."""
    text = F.concat(F.lit("ORD-"), _key(), F.lit(" *cost* “"), _price(), F.lit("”"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("a"), _key()).alias("anchor"), text.alias("text"))


_O = """o as (select *, o_custkey doc, o_orderkey k, 'a' || o_orderkey anchor, '$' || round(o_totalprice / 1000)::bigint || 'k' price, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) next from orders)"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote of each order: of its own section, of it and the next one, or of none."""
    o = table(spark, sf_dir, "orders").withColumn("next", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    own = F.concat(F.lit("ORD-"), _key(), F.lit('  cost "'), _price(), F.lit('"'))
    return o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seq"), _status(own, F.concat(own, F.lit(" ORD-"), F.col("next").cast("string"), F.lit(" cost")), F.lit("nowhere")).alias("quote"), "o_orderstatus", _price().alias("price"))


@query(f"with {_O} select doc, k seq, anchor from o where o_orderstatus = 'F' or o_orderstatus = 'O' and next is not null")
def q81_located_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where quotes begin, within one section or across two."""
    return notes.located_in(_quotes(spark, sf_dir).select("doc", "seq", "quote"), _places(spark, sf_dir))


@query(f"""with {_O} select doc, case when o_orderpriority = '5-LOW' then 'missing key surface' when o_orderstatus = 'P' or o_orderstatus = 'O' and next is null then 'quote not found verbatim'
  when o_orderpriority = '1-URGENT' then 'surface not inside the quote' else 'kept' end outcome, count(*) n from o group by all""")
def q82_checked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of notes: those without a surface, without their quote, or with another surface are dropped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seq"), "o_orderpriority")
    surface = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string")).when(F.col("o_orderpriority") == "1-URGENT", "€0").otherwise(F.col("price"))
    items = _quotes(spark, sf_dir).withColumn("quote", F.coalesce("quote", F.lit("nowhere"))).join(o, ["doc", "seq"]).select("doc", "seq", surface.alias("surface"), "quote", F.lit("").alias("anchor"))
    kept, dropped = notes.checked_items(items, _places(spark, sf_dir), ["surface", "quote"])
    both = kept.select("doc", F.lit("kept").alias("outcome")).unionByName(dropped.select("doc", F.col("reason").alias("outcome")))
    return both.groupBy("doc", "outcome").agg(F.count("*").alias("n"))


@query("""with l as (select o_custkey doc, l_partkey part, l_quantity q from lineitem join orders on o_orderkey = l_orderkey where l_quantity >= 49),
f as (select doc, 'about p ' || part || ' here' quote from l where q = 50)
select distinct doc, part seq from l where q = 49 and not exists (select 1 from f where f.doc = l.doc and contains(f.quote, 'p ' || part))""")
def q83_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered by 49 that no flag on parts ordered by 50 covers."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc")), "l_orderkey")  # noqa: E741
    part = F.concat(F.lit("P-"), F.col("l_partkey").cast("string"))
    flags = l.where("l_quantity = 50").select("doc", F.concat(F.lit("About "), part, F.lit(" here")).alias("quote"))
    return notes.uncovered(l.where("l_quantity = 49").select("doc", F.col("l_partkey").alias("seq"), part.alias("value")), flags).select("doc", "seq")


@query(f"""with {_O} select k id, case when o_orderstatus = 'F' then 'ORD-' || k else price end as first, case when o_orderstatus = 'P' then 1 else 2 end::int n,
  case when o_orderstatus = 'P' then price when o_orderstatus = 'F' then price else 'ORD-' || k end as "last" from o""")
def q84_about_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What flags are about: values that stand in their quotes, then named ones that do."""
    o = table(spark, sf_dir, "orders")
    order = F.concat(F.lit("ORD-"), _key())
    quote = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("cost "), _price())).otherwise(F.concat(order, F.lit(" **cost** "), _price()))
    about = F.when(F.col("o_orderstatus") == "F", F.array(order, F.lit("nowhere"), order)).otherwise(F.array(_price(), F.lit(None).cast("string")))
    said = o.select(F.col("o_orderkey").alias("id"), notes.about_values(about, quote, F.array(order, _price(), order, F.lit(""))).alias("v"))
    return said.select("id", F.get("v", F.lit(0)).alias("first"), F.size("v").alias("n"), F.element_at("v", -1).alias("last"))


@query(f"""with {_O}, a as (select doc, k, price, case when o_orderstatus = 'P' then 2 else 1 end attempt from o),
s as (select doc, price, min((attempt, k)) at from a group by all) select doc, row_number() over (partition by doc order by "at") - 1 seq, price as surface from s""".replace("min((attempt, k)) at", 'min((attempt, k)) "at"'))
def q85_merged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of two attempts at a note: the first's, then what only the second has."""
    o = table(spark, sf_dir, "orders")
    items = lambda df: df.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seq"), _price().alias("surface"))
    return notes.merged(items(o.where("o_orderstatus <> 'P'")), items(o.where("o_orderstatus <> 'F'"))).select("doc", F.col("seq").cast("long").alias("seq"), "surface")


def _said(spark: SparkSession, sf_dir: str, quote: Column, where: str = "true") -> DataFrame:
    """Flags of orders, each a document of its customer's matter."""
    return table(spark, sf_dir, "orders").where(where).select(F.col("o_custkey").alias("matter"), F.concat(F.lit("D"), _key()).alias("doc"), F.lit(0).alias("seq"), quote.alias("quote"), F.concat(F.lit("a"), _key()).alias("anchor"))


@query(f"""with {_O} select r.doc matter, r.anchor reserve_anchor, e.anchor estimate_anchor from o r join o e on e.doc = r.doc and e.k <> r.k where r.o_orderstatus = 'F' and e.o_orderstatus = 'P'""")
def q86_reserve_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserves of done orders against the ranges of pending ones, by customer."""
    f = _said(spark, sf_dir, F.concat(F.lit("a reserve of "), _price()), "o_orderstatus = 'F'").unionByName(_said(spark, sf_dir, F.concat(F.lit("costs of $1k to "), _price()), "o_orderstatus = 'P'"))
    surface = F.regexp_extract("quote", r"\$[0-9]+k$", 0)
    return dossier.reserve_rows(f.select("matter", "doc", "seq", surface.alias("surface"), "quote", "anchor")).select("matter", "reserve_anchor", "estimate_anchor")


@query(f"""with {_O}, d as (select *, (k % 5 + 30)::varchar n_days from o) select l.doc matter, l.anchor limit_anchor, p.anchor practice_anchor, l.n_days as number from d l join d p on p.doc = l.doc and p.k <> l.k and p.n_days = l.n_days
where l.o_orderstatus = 'F' and p.o_orderstatus = 'O'""")
def q87_policy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits in days of done orders against open ones that hold another number beside the same days."""
    days = (F.col("o_orderkey") % 5 + 30).cast("string")
    limit = _said(spark, sf_dir, F.concat(F.lit("The limit is "), days, F.lit(" days")), "o_orderstatus = 'F'")
    held = _said(spark, sf_dir, F.concat(F.lit("held 7, over "), days, F.lit(" days")), "o_orderstatus = 'O'")
    surface = F.regexp_extract("quote", "[0-9]+ days$", 0)
    figures = limit.unionByName(held).select("matter", "doc", "seq", surface.alias("surface"), "quote", "anchor")
    return dossier.policy_rows(limit, figures).select("matter", "limit_anchor", "practice_anchor", "number")


@query(f"with {_O} select c.doc matter, c.anchor clause_anchor, s.anchor seed_anchor from o c join o s on s.doc = c.doc and s.k <> c.k where c.o_orderstatus = 'F' and s.o_orderstatus = 'P'")
def q88_covenant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done orders that end an agreement against the first flags of pending ones, the seeds of a customer's matter."""
    flags = _said(spark, sf_dir, _status(F.lit("we terminate it"), F.lit("an open point"), F.lit("the leak")))
    seeds = _said(spark, sf_dir, F.lit(""), "o_orderstatus = 'P'").select("matter", "doc")
    return dossier.covenant_rows(flags, seeds).select("matter", "clause_anchor", "seed_anchor")


@query(f"""with {_O}, p as (select doc matter, k, next, anchor, lead(anchor) over (partition by doc order by k) next_anchor from o)
select matter, anchor a_anchor, next_anchor b_anchor, 3::int shared from p where next is not null""")
def q89_version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order and the next one of its customer as draft and final, by the flags that share most words."""
    first = _said(spark, sf_dir, F.lit("nothing shared at all"))
    flags = first.unionByName(_said(spark, sf_dir, F.concat(F.lit("Harbor lease ends "), F.lit("w"), _key())).withColumn("seq", F.lit(1)))
    only = flags.withColumn("quote", F.when(F.col("seq") == 0, F.concat("quote", F.lit(" "), "doc")).otherwise(F.col("quote"))).where("seq = 1")
    w = Window.partitionBy("matter").orderBy(F.substring("doc", 2, 12).cast("long"))
    pairs = first.select("matter", F.col("doc").alias("draft"), F.lead("doc").over(w).alias("final")).where("final is not null")
    return dossier.version_rows(pairs, only).select("matter", "a_anchor", "b_anchor", "shared")


@query("""with o as (select *, 'N' || c_nationkey report, '$' || round(o_totalprice / 1000)::bigint || ',000' price, 'C' || o_custkey cust from orders join customer on c_custkey = o_custkey),
t as (select report, string_agg(cust || ' paid US' || price || ' late', chr(10) order by o_orderkey) as text from o where o_orderstatus = 'F' group by 1)
select report, o_orderkey fact, coalesce(contains(lower(text), lower(cust)) and contains(replace(replace(lower(text), 'us$', ' '), ',000', '000'), replace(substr(price, 2), ',', '')), false) hit from o left join t using (report)""")
def q90_recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of all orders as facts, against each nation's report of its done ones."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("report"))
    o = table(spark, sf_dir, "orders").join(c, "o_custkey")
    price, customer = F.concat(F.lit("$"), F.round(F.col("o_totalprice") / 1000).cast("long").cast("string"), F.lit(",000")), F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    said = F.concat(customer, F.lit(" paid US"), price, F.lit(" late"))
    texts = o.where("o_orderstatus = 'F'").groupBy("report").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", said.alias("said")))), lambda x: x["said"]), "\n").alias("text"))
    facts = o.select("report", F.col("o_orderkey").alias("fact"), F.lit("number").alias("kind"), price.alias("value"), F.array(customer).alias("documents"))
    return verify.recalled(facts, texts)


@query("""with o as (select 'N' || c_nationkey dossier, case when o_orderstatus = 'P' then 2 else 1 end matter, 'C' || o_custkey doc from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT')
select dossier, matter, doc, count(*)::int weight from o group by all""")
def q91_document_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers weigh in the dossiers, by the names that they carry."""
    return digest.weights(dossiers(spark, sf_dir)).select("dossier", "matter", "doc", F.col("weight").cast("int").alias("weight"))


@query(f"""with {_O} select doc, anchor, strftime(o_orderdate, '%Y-%m-%d') as day, row_number() over (partition by doc order by o_orderdate, anchor)::int place from o""")
def q92_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated statements of their customers, by day."""
    day = F.date_format("o_orderdate", "d MMMM yyyy")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.concat(F.lit("Ordered on "), day).alias("quote"), F.concat(F.lit("a"), _key()).alias("anchor"))
    return report.timeline(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.lit("1990-01-01").alias("day"))).select("doc", "anchor", "day", F.col("place").cast("int").alias("place"))


@query("""with l as (select distinct o_custkey doc, l_partkey part, min(l_orderkey) over (partition by o_custkey, l_partkey) seq from lineitem join orders on o_orderkey = l_orderkey where l_quantity >= 45)
select 'P-' || part as value, doc, seq from l where part in (select part from l group by part having count(distinct doc) >= 2)""")
def q93_shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that notes of two customers refer to, by the first reference of each."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc"))
    refs = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").join(o, "l_orderkey").select("doc", F.col("l_orderkey").alias("seq"), F.lit("code").alias("kind"), F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("value"), F.lit("q").alias("quote"), F.lit("a").alias("anchor"))
    return report.shared_names(refs, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"))).select("value", "doc", "seq")


@query(f"""with {_O}, m as (select doc, max(round(o_totalprice)) money from o where o_orderstatus <> 'P' group by doc)
select c_nationkey room, doc, money, row_number() over (partition by c_nationkey order by money desc nulls last, doc)::int place from m join customer on c_custkey = doc where c_acctbal < 0""")
def q94_lesser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt, outside their nation's set of those in credit, by their largest money."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_nationkey").alias("room"), "c_acctbal")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("doc"), F.concat(F.lit("$"), F.round("o_totalprice").cast("long").cast("string")).alias("surface")).join(c, "doc")
    found = report.lesser(o.select("room", "doc", "surface"), c.where("c_acctbal >= 0").select("room", "doc"))
    return found.select("room", "doc", "money", F.col("place").cast("int").alias("place"))


@query("""with c as (select o_custkey doc, o_orderkey k from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P'), h as (select doc, max(k) k from c group by doc)
select doc matter, 'C' || doc as asked, 'C' || doc || '#' || k anchor, 'C' || (doc + 1) other from h semi join customer on c_custkey = doc + 1""")
def q95_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last urgent open order of each customer asks for a comparison with the customer of the next number, one of whose sections answers."""
    name = lambda key: F.concat(F.lit("C"), key.cast("string"))
    last = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    c = table(spark, sf_dir, "customer")
    nodes = c.select(name(F.col("c_custkey")).alias("doc"), F.concat(name(F.col("c_custkey")), F.lit(".md")).alias("path"))
    at = F.concat(name(F.col("o_custkey")), F.lit("#"), F.col("k").cast("string"))
    references = last.select(name(F.col("o_custkey")).alias("doc"), name(F.col("o_custkey") + 1).alias("value"), at.alias("anchor"))
    asks = last.select(name(F.col("o_custkey")).alias("doc"), at.alias("anchor"), F.concat(F.lit("Reconcile the harbor account with "), name(F.col("o_custkey") + 1)).alias("text"), F.lit(1).alias("ordinal"))
    answers = c.select(name(F.col("c_custkey")).alias("doc"), F.concat(name(F.col("c_custkey")), F.lit("#0")).alias("anchor"), F.lit("Harbor account").alias("text"), F.lit(0).alias("ordinal"))
    sets = c.select(F.col("c_custkey").alias("matter"), name(F.col("c_custkey")).alias("doc")).unionByName(c.select(F.col("c_custkey").alias("matter"), name(F.col("c_custkey") + 1).alias("doc")))
    found = dossier_text.compare_rows(sets.join(nodes.select("doc"), "doc", "left_semi"), nodes, references, asks.unionByName(answers))
    part = lambda k: F.get(F.split("row", "\u0001"), F.lit(k))
    return found.select("matter", part(1).alias("asked"), part(2).alias("anchor"), part(3).alias("other")).distinct()


@query("""with n as (select c_mktsegment as name, c_custkey doc from customer), k as (select name, count(*) n from n group by 1)
select name, greatest(n // 3, 0)::bigint least, ((n + 2) // 3)::bigint as most, 3::bigint spellings from k""")
def q96_dealt_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of segments dealt round their customers: how many customers have the rarest and the commonest one."""
    c = table(spark, sf_dir, "customer")
    sections = c.select(F.col("c_custkey").alias("doc"), F.concat(F.lit("They are of "), "c_mktsegment", F.lit(", see x@"), "c_mktsegment", F.lit(".com")).alias("text"))
    names = c.select(F.col("c_mktsegment").alias("name")).distinct().select("name", F.array(F.lower("name"), F.initcap("name"), F.reverse("name")).alias("spellings"))
    counts = variants.dealt(sections, names).groupBy("name", "spelling").agg(F.count("*").alias("n"))
    return counts.groupBy("name").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("spellings"))


@query(f"""with {_O} select doc, k line, (round(o_totalprice / 1000)::bigint * 1000)::double as value, 'USD' unit from o union all select doc, k, (k % 90 + 2)::double, 'months' from o union all select doc, k, 12.5, 'percent' from o""")
def q97_amounts_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All amounts of sentences, each with the unit that it or the words behind it name."""
    said = F.concat(F.lit("ORD-"), _key(), F.lit(" of 2024-05-06 cost "), _price(), F.lit(" over twelve ("), (F.col("o_orderkey") % 90 + 2).cast("string"), F.lit(") whole months at 12.5%"))
    pieces = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ordinal"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("heading"), F.concat(F.lit("x#l"), _key()).alias("anchor"), said.alias("text"), F.lit(None).cast("array<struct<ref: string, value: string, number: double>>").alias("cells"))
    found = typed_index.amounts(pieces, typed_index.text_pieces(pieces), typed_index.line_rows(pieces))
    return found.select("doc", F.col("ordinal").alias("line"), F.col("value").cast("double").alias("value"), "unit")


@query("""with z as (select o_custkey doc, o_orderdate::date as day from orders), s as (select c_custkey seed, c_custkey + 1 other from customer), own as (select seed, day from s join z on doc = seed), o as (select seed, day from s join z on doc = other)
select seed, coalesce(min(day) filter (exists (select 1 from o where o.seed = own.seed and o.day = own.day)), min(day)) as date from own group by seed""")
def q98_matter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matters of a customer and the one of the next number: their earliest common day, else the customer's own earliest."""
    dated = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.to_date("o_orderdate").alias("day")).distinct()
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed"), F.col("c_custkey").alias("doc"))
    return links.matter_dates(seeds, seeds.unionByName(seeds.select("seed", (F.col("doc") + 1).alias("doc"))), dated)


@query(f"""with {_O} select k fact, o_orderstatus <> 'P' hit from o""")
def q99_planted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as planted facts of two documents, against notes of the first that quote done orders and of the second that quote open ones."""
    o = table(spark, sf_dir, "orders")
    doc = lambda end: F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(end))
    items = o.where("o_orderstatus <> 'P'").select(F.when(F.col("o_orderstatus") == "F", doc("a")).otherwise(doc("b")).alias("doc"), F.concat(F.lit("They shipped ord "), _key(), F.lit("; late")).alias("quote"))
    facts = o.select(F.col("o_orderkey").alias("fact"), F.concat(F.lit("ORD-"), _key(), F.lit(", late")).alias("value"), F.array(doc("a"), doc("b")).alias("documents"))
    return choices.planted_recall(facts, items)


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on every order, grouped by priority, in a room for each nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = table(spark, sf_dir, "orders").join(c, "o_custkey")
    group = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("room"), group.alias("group"), F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("doc"), F.lit("late").alias("finding"), F.concat(F.lit('"ORD-'), _key(), F.lit('  late"')).alias("quote"), F.concat(F.lit("a"), _key()).alias("anchor"), "o_orderstatus")


@query("select o_orderkey place, 'N' || c_nationkey room from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'F'")
def q100_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose quote their nation's text of done orders does not hold."""
    found = _choices(spark, sf_dir)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.col("place"))), lambda k: F.concat(F.lit("ORD-"), k.cast("string"), F.lit(" late"))), "\n")
    return choices.unseen(found, found.where("o_orderstatus = 'F'").groupBy("room").agg(text.alias("text"))).select("place", "room")


@query("""with f as (select 'N' || c_nationkey room, o_custkey doc, substr(o_orderpriority, 1, 1)::int g, o_orderkey k from orders join customer on c_custkey = o_custkey)
select room, doc, k place, dense_rank() over (partition by room order by doc)::int as rank, row_number() over (partition by room, doc order by g, k)::int as "position" from f""")
def q101_findings_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by customer in the order of customers, and by group within each."""
    c = table(spark, sf_dir, "customer")
    nodes = c.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("room"), F.col("c_custkey").alias("doc"), F.col("c_custkey").alias("place"), F.col("c_name").alias("title"))
    found = choices.by_document(_choices(spark, sf_dir), nodes)
    return found.select("room", "doc", "place", "rank", F.col("at").alias("position"))


@query("""select o_orderkey id, case o_orderpriority when '1-URGENT' then (round(o_totalprice) * 2.0::double + 4000.0::double) / 1000000.0::double when '2-HIGH' then 0.0::double end dollars from orders""")
def q102_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls of models, priced where there is a rate."""
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("model"), F.round("o_totalprice").cast("long").alias("tokens_in"), F.lit(1000).cast("long").alias("tokens_out"))
    rates = spark.createDataFrame([("1-URGENT", 2.0, 4.0), ("2-HIGH", 0.0, 0.0)], "model string, rate_in double, rate_out double")
    return choices.priced(calls, rates)


@query("""with l as (select distinct o_custkey doc, l_partkey part from lineitem join orders on o_orderkey = l_orderkey where l_quantity = 50), p as (select o_custkey doc, o_orderkey piece, string_agg(' p ' || l_partkey || ' ', '') said from lineitem join orders on o_orderkey = l_orderkey group by all)
select l.doc, piece, 'P-' || part as value from l join p on p.doc = l.doc and contains(said, ' p ' || part)""")
def q103_named_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered by 50, and the orders of their customers that write them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc"))
    l = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").withColumn("part", F.concat(F.lit("P-"), F.col("l_partkey").cast("string")))  # noqa: E741
    named = l.where("l_quantity = 50").select("doc", F.col("l_partkey").alias("seq"), F.col("part").alias("value")).distinct()
    pieces = l.groupBy("doc", F.col("l_orderkey").alias("piece")).agg(F.concat(F.lit("; "), F.array_join(F.sort_array(F.collect_list("part")), "; ")).alias("text"))
    return choices.named_in_pieces(named, pieces).select("doc", "piece", "value")
