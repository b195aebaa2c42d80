"""Queries on names, links, anchors, periods, stems and rows, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import anchors as A
from tessera.functions import carry
from tessera.functions import dates as D
from tessera.functions import rows as R
from tessera.functions.text import COMMON_WORDS, amount, header_scale, header_unit
from tessera.functions.words import fold, folded_words
from tessera.operators import filings, graph, index, links, ranking, report
from tessera.plans.catalog import _EDGES, _LINES, _ROWS, QUERIES, SQL, _edges, query
from tessera.plans.views import document_lines, order_rows, part_carriers, table

_FOLD = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a person whose name is written in three ways: doc, seq, kind, value."""
    n = F.col("c_custkey").cast("string")
    ways = F.array(F.concat(F.lit("Ann K"), n, F.lit(" Smith")), F.concat(F.lit("K"), n, F.lit(" Smith, Ann")), F.concat(F.lit("ANN-K"), n, F.lit("-SMITH Ltd.")))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.posexplode(ways).alias("seq", "value"))
    return own.withColumn("kind", F.when((F.col("doc") % 3 == 0) & (F.col("seq") > 0), "name").otherwise("person"))


_SPELT = """spelt as (select c_custkey doc, unnest(range(0, 3))::int seq, unnest(['Ann K' || c_custkey || ' Smith', 'K' || c_custkey || ' Smith, Ann', 'ANN-K' || c_custkey || '-SMITH Ltd.']) as value from customer)"""


@query(f"""with recursive {_SPELT},
w as (select distinct value, string_split({_FOLD.format('value')}, ' ') ws from spelt union select distinct value, string_split({_FOLD.format("regexp_extract(value, '^[^,]*,(.*)$', 1)")} || ' ' || {_FOLD.format("regexp_extract(value, '^([^,]*),', 1)")}, ' ') from spelt where contains(value, ',')),
x as (select value, case when ws[-1] in ('group', 'inc', 'llp', 'ltd', 'plc') then ws[:-2] else ws end ws from w),
f as (select distinct value, unnest(case when len(ws) = 2 then [array_to_string(ws, ''), left(ws[1], 1) || ws[2]] else [array_to_string(ws, '')] end) form from x),
e as (select distinct a.value x, b.value y from f a join f b using (form)),
r as (select x node, y other from e union select r.node, e.y from r join e on e.x = r.other),
g as (select node as value, min(other) spelling from r group by 1),
k as (select spelling, min(form) as key from f join g using (value) group by 1)
select distinct form, key, spelling from f join g using (value) join k using (spelling)""")
def q23_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.name_groups(_spellings(spark, sf_dir))


@query(f"""with {_SPELT}, k as (select doc, case when doc % 3 = 0 and seq > 0 then 'name' else 'person' end kind from spelt)
select least('annk' || doc || 'smith', 'k' || doc || 'smithann') as name from k group by doc having count(*) filter (kind = 'person') >= count(*) filter (kind <> 'person')""")
def q50_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = _spellings(spark, sf_dir)
    return links.person_values(spelt, links.name_groups(spelt))


@query("""select distinct 'C-' || o_custkey citing, 'C-' || (o_orderkey % 2000) cited from orders where (o_orderkey % 2000) in (select c_custkey from customer) and o_custkey <> o_orderkey % 2000""")
def q51_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, orders as their references to others."""
    o = table(spark, sf_dir, "orders")
    references = o.select(F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("doc"), F.concat(F.lit(" c-"), (F.col("o_orderkey") % 2000).cast("string"), F.lit(" ")).alias("value"))
    return links.citations(references, table(spark, sf_dir, "customer").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("doc")))


_SEEDS = [(1, 1), (1, 2), (2, 3)]


@query(f"""with {_EDGES}, bothways as (select a doc, b other, value, weight from e union all select b, a, value, weight from e), z(seed, head) as (values (1, 1), (1, 2), (2, 3)),
m as (select seed, doc, other head, value, weight from bothways join z on other = head where not exists (select 1 from z y where y.seed = z.seed and y.head = bothways.doc)),
hd as (select seed, doc, string_agg(distinct head::varchar, ',' order by head::varchar) as heads from m group by 1, 2),
v as (select seed, doc, value, row_number() over (partition by seed, doc order by max(weight) desc, value) r from m where not regexp_matches(value, '^[0-9][0-9,]*$') group by 1, 2, 3)
select seed, doc, heads, string_agg(value, ',' order by value) as "values" from hd join v using (seed, doc) where r <= 3 group by 1, 2, 3""".replace("l_partkey::varchar", "('p' || l_partkey)"))
def q52_shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share parts with those of two seeds."""
    seeds, most = spark.createDataFrame(_SEEDS, "seed int, doc long"), graph.breadth(table(spark, sf_dir, "supplier").count())
    edges = graph.edges_of(part_carriers(spark, sf_dir), most, seeds, graph.KIND_WEIGHTS["identifier"]).withColumn("value", F.concat(F.lit("p"), "value"))
    found = links.shared_links(seeds, links.written(links.value_links(edges), "shared"))
    return found.select("seed", "doc", F.array_join("from", ",").alias("heads"), F.array_join("values", ",").alias("values"))


_PLACES = "case l_linenumber % 6 when 0 then 'p' || l_quantity::int || 't' || l_linenumber || 'r' || l_suppkey when 1 then 'p' || l_quantity::int || 'l' || l_suppkey when 2 then 'm' || l_quantity::int || 'l' || l_suppkey when 3 then 'l' || l_suppkey when 4 then 'r' || l_suppkey else 'Sheet ' || l_returnflag || '!' || l_linestatus || l_suppkey end"


@query(f"""with a as (select l_orderkey || '#x' doc, {_PLACES} place from lineitem),
k as (select doc, place, case when regexp_matches(place, '^p[0-9]+t') then 'page-table-row' when regexp_matches(place, '^p[0-9]+l') then 'page-line' when place[1] = 'm' then 'message-line' when place[1] = 'l' then 'line' when place[1] = 'r' then 'row' else 'sheet-cell' end kind,
 regexp_extract(place, '([0-9]+)$', 1)::bigint last, regexp_extract(place, '^[pm]([0-9]+)', 1) first, regexp_extract(place, '^(.+)!', 1) sheet from a)
select kind, count(*) n, count(distinct doc) docs, sum(last)::bigint as last, sum(case when first = '' then 0 else first::bigint end)::bigint as first, max(sheet) sheet from k group by 1""")
def q53_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as anchors of all kinds, written and read again."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    doc, page, at, number = F.concat(F.col("l_orderkey").cast("string"), F.lit("#x")), F.col("l_quantity").cast("int"), F.col("l_suppkey"), F.col("l_linenumber") % 6
    made = (
        F.when(number == 0, A.page_table_row(doc, page, F.col("l_linenumber"), at)).when(number == 1, A.page_line(doc, page, at)).when(number == 2, A.message_line(doc, page, at))
        .when(number == 3, F.concat(doc, F.lit("#l"), at.cast("string"))).when(number == 4, A.row_anchor(doc, at)).otherwise(A.sheet_cell(doc, F.concat(F.lit("Sheet "), "l_returnflag"), F.col("l_linestatus"), at))
    )
    p = l.select(A.parse_anchor(made).alias("a")).select("a.*")
    sheet = F.when(F.col("kind") == "sheet-cell", F.col("sheet")).otherwise("")
    return p.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs"), F.sum(F.coalesce("row", "line").cast("long")).alias("last"), F.sum(F.coalesce("page", "message", F.lit(0)).cast("long")).alias("first"), F.max(sheet).alias("sheet"))


@query("""with d as (select o_orderkey % 5 k, o_orderdate::date as day from orders),
s as (select case k when 0 then strftime(day, '%Y-%m-%d') when 1 then strftime(day, '%-d %B %Y') when 2 then strftime(day, '%Y-%m') when 3 then strftime(day, '%B %Y') else 'FY' || year(day) || '-Q' || quarter(day) end surface,
 case when k < 2 then 'day' when k < 4 then 'month' else 'quarter' end grain, case when k < 2 then strftime(day, '%Y-%m-%d') when k < 4 then strftime(day, '%Y-%m') else year(day) || '-Q' || quarter(day) end period from d)
select grain, period, count(*) n, count(distinct surface) surfaces from s group by 1, 2""")
def q54_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders, written in five ways and read as periods."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    surface = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "d MMMM yyyy")).when(k == 2, F.date_format(day, "yyyy-MM")).when(k == 3, F.date_format(day, "MMMM yyyy")).otherwise(F.concat(F.lit("FY"), F.year(day), F.lit("-Q"), F.quarter(day)))
    own = table(spark, sf_dir, "orders").select(surface.alias("surface")).withColumn("p", D.period(F.col("surface")))
    return own.groupBy("p.grain", D.period_text(F.col("p")).alias("period")).agg(F.count("*").alias("n"), F.countDistinct("surface").alias("surfaces"))


def _stem_sql(w: str) -> str:
    return "case " + " ".join(f"when {w} like '%{e}' and length({w}) >= {len(e) + 3} then left({w}, length({w}) - {len(e)})" for e in carry.ENDINGS) + f" else {w} end"


@query(rf"""with w as (select item_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]{{2,}}'), lambda x: lower(x))) w from benchmark), s as (select distinct item_id, {_stem_sql('w')} s from w)
select item_id, count(*) n, string_agg(s, ' ' order by s) stems from s where s not in ({", ".join(f"'{x}'" for x in sorted({carry._stemmed(w) for w in carry.STOPS}))}) group by 1""")
def q55_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "benchmark").select("item_id", carry.words_of(F.col("text")).alias("stems")).where(F.size("stems") > 0)
    return own.select("item_id", F.size("stems").cast("long").alias("n"), F.array_join(F.array_sort("stems"), " ").alias("stems"))


@query(f"""with w as (select c_custkey doc, unnest(list_distinct(string_split({_FOLD.format("c_name || ' ' || c_mktsegment")}, ' '))) word from customer)
select min(doc) doc, word from w where length(word) > 2 and word not in ({", ".join(f"'{w}'" for w in COMMON_WORDS)}) group by word having count(distinct doc) = 1""")
def q56_title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(folded_words(F.concat_ws(" ", "c_name", "c_mktsegment")), lambda w: (F.length(w) > 2) & ~w.isin(*COMMON_WORDS))
    return report.unique_title_words(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), words.alias("words")))


@query(rf"""with {_ROWS}, u as (select doc, line, unnest(string_split(text, ' | ')) unit, unnest(range(0, len(string_split(text, ' | '))))::int as "at" from lines)
select doc, line, "at", unnest(regexp_extract_all(unit, '\$[0-9][0-9,]*(?:\.[0-9]+)?')) surface, unit quote from u""")
def q57_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money and percentages of each unit of the rows of orders."""
    own = order_rows(spark, sf_dir).select("doc", "line", F.posexplode(carry.units(F.col("text"))).alias("at", "quote"))
    return own.select("doc", "line", "at", F.explode(carry.amount_surfaces(F.col("quote"))).alias("surface"), "quote")


@query(f"""with {_LINES}, c as (select doc, line, sum(length(text) + 1) over (partition by doc order by line rows between unbounded preceding and 1 preceding) before, sum(length(text) + 1) over (partition by doc) whole from lines),
r as (select doc, line, row_number() over (partition by doc order by abs(whole - 2 * before), line) i from c where before is not null) select doc, line as cut from r where i = 1""")
def q58_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pieces_halved(document_lines(spark, sf_dir))


@query("""with recursive s as (select o_custkey room, row_number() over (partition by o_custkey order by o_orderkey) place, round(o_totalprice)::bigint size from orders),
g as (select room, place, 1::bigint as "group", size total from s where place = 1
 union all select s.room, s.place, case when g.total + s.size <= 500000 then g."group" else g."group" + 1 end, case when g.total + s.size <= 500000 then g.total + s.size else s.size end from g join s on s.room = g.room and s.place = g.place + 1)
select room, place, "group" from g""")
def q59_budget_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer in groups of up to 500,000 dollars."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("room"), place.alias("place"), F.round("o_totalprice").cast("long").alias("size"))
    return ranking.within_budget(own, 500_000)


@query("""with d as (select distinct o_orderpriority p, date_trunc('month', o_orderdate)::date as m from orders), s as (select p, m, (year(m) * 12 + month(m)) - lag(year(m) * 12 + month(m)) over (partition by p order by m) step from d)
select p || '/Pack' stem, 'month' step, count(*) n, strftime(min(m), '%Y-%m') as first, strftime(max(m), '%Y-%m') as last from s group by p having count(*) >= 2 and min(step) = 1 and max(step) = 1""")
def q60_document_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly packs of orders by priority, found by their file names."""
    paths = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit("/Pack_"), F.date_format("o_orderdate", "yyyy_MM"), F.lit(".pdf")).alias("doc")).distinct()
    found = index.document_series(paths)
    return found.select(F.regexp_replace("before", "_$", "").alias("stem"), "step", "n", "first", "last")


@query("""select 'Price ($' || s || ')' header, 'USD' unit, case s when 'M' then 1e6 when 'k' then 1e3 when 'bn' then 1e9 else 1.0 end::double scale, count(*) n, round(sum(p_retailprice), 2) total
from (select *, case p_size % 4 when 0 then 'M' when 1 then 'k' when 2 then 'bn' else 'x' end s from part) group by s""")
def q61_header_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts under headers that scale them."""
    k = F.col("p_size") % 4
    header = F.concat(F.lit("Price ($"), F.when(k == 0, "M").when(k == 1, "k").when(k == 2, "bn").otherwise("x"), F.lit(")"))
    own = table(spark, sf_dir, "part").withColumn("header", header).groupBy("header").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))
    return own.select("header", header_unit(F.col("header")).alias("unit"), header_scale(F.col("header")).alias("scale"), "n", "total")


@query("""select '- ' || o_orderpriority || ' | C' || o_custkey || ' | ' || o_orderstatus || ' | ' || floor(o_totalprice)::int || ' | C' || o_custkey || '#l' || o_orderkey as text, 'C' || o_custkey document,
 o_orderstatus || ' | ' || floor(o_totalprice)::int as quote, '- ' || o_orderpriority || ' | "' || o_orderstatus || ' | ' || floor(o_totalprice)::int || '" | [C' || o_custkey || ' | C' || o_custkey || '#l' || o_orderkey || ']' as line, 'C' || o_custkey || '#l' || o_orderkey as cited from orders""")
def q62_evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a dossier, and as cited lines of the schedule."""
    doc = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    quote = F.concat_ws(" | ", "o_orderstatus", F.floor("o_totalprice").cast("int").cast("string"))
    own = table(spark, sf_dir, "orders").select(R.row(F.col("o_orderpriority"), doc, F.concat(quote, F.lit(" | ")), F.concat(doc, F.lit("#l"), F.col("o_orderkey").cast("string"))).alias("text"))
    line = R.evidence_line(F.col("text"))
    return own.select("text", R.row_document(F.col("text")).alias("document"), R.row_quote(F.col("text")).alias("quote"), line.alias("line"), F.get(R.citations(line), F.lit(0))["anchor"].alias("cited"))


@query(f"""with v as (select distinct {_FOLD.format("p_type")} as value from part), w as (select value, string_split(value, ' ') ws from v),
r as (select distinct array_to_string(ws[i:j], ' ') run, value from (select value, ws, unnest(range(1, len(ws) + 1)) i from w), (select unnest(range(1, 12)) j) where j >= i and j <= len(ws))
select run, count(*) n_values from r group by 1""")
def q63_written_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts as values that notes write, and all runs of words within them."""
    references = table(spark, sf_dir, "part").select(F.lit("code").alias("kind"), F.col("p_type").alias("value"))
    values = links.written_values(references, spark.createDataFrame([], "surface string"))
    return links.runs_of(values.withColumn("own", fold(F.col("value"))), "own").groupBy("run").agg(F.count("*").alias("n_values"))


@query("""with s as (select s_nationkey matter, s_suppkey doc, case when s_acctbal > 0 then 'There is no material claim' else 'Materiality is still pending' end quote from supplier)
select a.matter, a.doc said_doc, b.doc open_doc from s a join s b using (matter) where a.doc <> b.doc and a.quote like 'There%' and b.quote like 'Mat%'""")
def q64_warranties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation that warrant against those that reserve, by the sign of their balance."""
    quote = F.when(F.col("s_acctbal") > 0, "There is no material claim").otherwise("Materiality is still pending")
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("matter"), F.col("s_suppkey").alias("doc"), quote.alias("quote"), F.col("s_name").alias("anchor"))
    return report.warranties(own).select("matter", "said_doc", "open_doc")


@query("""with s as (select l_linenumber % 4 k, l_quantity::int q, l_extendedprice p from lineitem)
select case k when 0 then 'USD' when 1 then 'percent' when 2 then 'days' else '' end unit, count(*) n, round(sum(case when k = 0 then round(p, 2) when k = 3 then q * 1e6 else q end), 2)::double total from s group by 1""")
def q65_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and prices of line items, written as amounts and read again."""
    k, q = F.col("l_linenumber") % 4, F.col("l_quantity").cast("int").cast("string")
    price = F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice"), 2))
    surface = F.when(k == 0, price).when(k == 1, F.concat(q, F.lit("%"))).when(k == 2, F.concat(q, F.lit("-day"))).otherwise(F.concat(q, F.lit("m")))
    own = table(spark, sf_dir, "lineitem").select(amount(surface).alias("a")).select("a.*")
    return own.groupBy(F.coalesce("unit", F.lit("")).alias("unit")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""with s as (select distinct p_size, round(p_retailprice)::int price from part)
select 'p' || p_size || '-' || price id, printf('%g', price::double) number, printf('%g', p_size::double) size from s""")
def q66_figure_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and prices of parts as figures, with and without currency and unit."""
    price = F.round("p_retailprice").cast("int").cast("string")
    own = table(spark, sf_dir, "part").select("p_size", price.alias("price")).distinct()
    return own.select(F.concat(F.lit("p"), F.col("p_size").cast("string"), F.lit("-"), "price").alias("id"), links.figure_number(F.concat(F.lit("$"), "price", F.lit("m"))).alias("number"), links.figure_number(F.col("p_size")).alias("size"))


_DAYS = """c as (select distinct 'd' || o_orderdate::date as value, o_custkey doc from orders),
h as (select value, count(*) carriers from c group by 1 having count(*) between 2 and (select greatest(2, (count(*) // 2)) from customer)),
e as (select a.doc a, b.doc b, a.value, round(1.0 / carriers, 6)::double weight from c a join c b on a.value = b.value and a.doc < b.doc join h on h.value = a.value)"""


@query(f"""with {_DAYS}, pairs as (select draft, final from ({SQL["q12_version_pairs"]})),
both_ as (select a doc, b other, weight from e union all select b, a, weight from e), m as (select doc, other, max(weight) weight from both_ group by 1, 2),
k as (select doc, weight, row_number() over (partition by doc order by weight desc, other) i from m), s as (select doc seed, round(sum(weight), 6) pull from k where i <= 3 group by doc order by pull desc, seed limit 25),
i1 as (select seed, seed doc, 'seed' kind from s union all select distinct seed, doc, 'shared' from s join both_ on other = seed where doc <> seed),
p2 as (select draft doc, final other from pairs union all select final, draft from pairs),
i2 as (select distinct i1.seed, p2.doc, 'version' kind from i1 join p2 on p2.other = i1.doc where not exists (select 1 from i1 x where x.seed = i1.seed and x.doc = p2.doc))
select seed, doc, kind from i1 union all select seed, doc, kind from i2""")
def q67_matter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets grown from the 25 strongest customers: those that ordered on the same days, then other halves of versions."""
    o = table(spark, sf_dir, "orders")
    carriers = o.select(F.lit("identifier").alias("kind"), F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("value"), F.col("o_custkey").alias("doc"))
    most = graph.breadth(table(spark, sf_dir, "customer").count())
    seeds = links.written(graph.pull(graph.strongest_links(carriers, most)).orderBy(F.desc("pull"), "doc").limit(25).select(F.col("doc").alias("seed"), "doc"), "seeds")
    edges = links.written(graph.edges_of(carriers, most, seeds), "edges")
    shared, versions = links.value_links(edges), QUERIES["q12_version_pairs"](spark, sf_dir).select("draft", "final")
    _, every = links.grown(seeds, [lambda s: links.shared_links(s, shared), lambda s: links.version_links(versions, s)])
    return seeds.withColumn("kind", F.lit("seed")).unionByName(every.select("seed", "doc", "kind"))


@query()
def q68_filing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as filings, split at their headings."""
    return filings.split_filings(document_lines(spark, sf_dir)).select("doc", "number", "file", F.length("text").alias("chars"))
