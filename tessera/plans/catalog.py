"""All registered queries over the tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph, index, links, ranking, sections, verify
from tessera.plans.views import daily_events, document_lines, order_rows, part_carriers, table
from tessera.streaming.progress import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LINES = r"lines as (select doc_id doc, unnest(string_split(text, chr(10))) as text, unnest(range(1, len(string_split(text, chr(10))) + 1))::bigint as line from documents)"
_ROWS = r"""lines as (select o_custkey doc, o_orderkey line, concat_ws(' | ', 'ORD-' || lpad(o_orderkey::varchar, 6, '0'), strftime(o_orderdate, '%Y-%m-%d'), '$' || printf('%.2f', o_totalprice), o_orderstatus, o_orderpriority) as text from orders)"""
_BLANK = "trim(text, ' ') = ''"
_HEADING = r"(not contains(text, chr(10)) and (regexp_matches(text, '^[0-9]+(?:\.[0-9]+)*\.? +[A-Z]') or (regexp_matches(text, '[A-Z].*[A-Z].*[A-Z].*[A-Z]') and not regexp_matches(text, '[a-z]'))))"
_NUMBER = r"regexp_matches(trim(text, ' '), '^-?[0-9][0-9,]*(?:\.[0-9]+)?$')"
_ROW = rf"(not contains(text, chr(10)) and (contains(text, ' | ') or {_NUMBER}))"
_BLOCKS = rf"""{_LINES},
marked as (select *, sum(case when {_BLANK} then 1 else 0 end) over (partition by doc order by line rows unbounded preceding) island from lines),
blocks as (select doc, min(line) line, count(*) n_lines, string_agg(text, chr(10) order by line) as text from marked where not ({_BLANK}) group by doc, island)"""


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _occurrences(pattern: str) -> str:
    return f"found as (select doc, line, unnest(regexp_extract_all(text, '{pattern}')) surface, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) n from lines)"


def _grouped(key: str, where: str = "true", having: str = "true") -> str:
    return f"""select {key} as value, count(*) n, count(distinct doc) n_docs, arg_min(surface, (doc, line, n)) surface, arg_min(doc || '#l' || line, (doc, line, n)) anchor from found where {where} group by 1 having {having}"""


def _placed(key: str, where: str = "true", having: str = "true") -> str:
    return f""", g as ({_grouped(key, where, having)}), p as (select distinct {key} as value, doc, doc || '#l' || line place from found where {where})
select g.*, doc, place from g join p using (value)"""


@query(f"with {_BLOCKS} select doc, line, n_lines, text from blocks")
def q01_sections_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.blocks(document_lines(spark, sf_dir))


@query(f"with {_LINES} select doc, line, last_value(case when {_HEADING} then text end ignore nulls) over (partition by doc order by line rows unbounded preceding) heading from lines")
def q02_heading_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.headed(document_lines(spark, sf_dir)).select("doc", "line", "heading")


@query(f"""with {_LINES}, m as (select *, sum(case when {_HEADING} or {_ROW} then 1 else 0 end) over (partition by doc order by line rows unbounded preceding) stop,
row_number() over (partition by doc order by line) n from lines) select doc, line, text, n from m where stop = 0 and n <= 10""")
def q03_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.front_matter(document_lines(spark, sf_dir)).select("doc", "line", "text", F.col("n").cast("long").alias("n"))


_RUNS = f"""{_LINES}, r as (select *, line - row_number() over (partition by doc order by line) island from lines where {_ROW}),
runs as (select doc, min(line) over (partition by doc, island) run, line, text, max(contains(text, ' | ')) over (partition by doc, island) barred from r),
cells as (select doc, run, line, unnest(string_split(text, ' | ')) as text, unnest(range(1, len(string_split(text, ' | ')) + 1))::int cell from runs where barred),
numbered as (select *, case when {_NUMBER} then replace(trim(text, ' '), ',', '')::double end number from cells)"""


@query(f"with {_RUNS} select doc, run, line, cell, text, number from numbered")
def q04_line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.line_cells(sections.line_runs(document_lines(spark, sf_dir)))


@query(f"""with {_RUNS.replace(_LINES, _ROWS.replace("concat_ws(' | ', 'ORD-'", "concat_ws(' | ', case when o_orderkey % 5 = 0 then 'Total' else o_custkey::varchar end, 'ORD-'"))}
select doc, run, line, cell, number from numbered where number is not null""")
def q04b_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("line") % 5 == 0, F.lit("Total")).otherwise(F.col("doc").cast("string"))
    rows = order_rows(spark, sf_dir).withColumn("text", F.concat_ws(" | ", key, "text"))
    return sections.line_cells(sections.line_runs(rows)).where("number is not null").select("doc", "run", "line", "cell", "number")


@query(rf"with {_LINES}, {_occurrences(r'\b[A-Za-z][A-Za-z0-9]*(?:[-_./][A-Za-z0-9]+)+\b')}{_placed('surface', where="regexp_matches(surface, '[0-9]')")}")
def q05_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.identifiers(document_lines(spark, sf_dir), by=index.placed)


@query(rf"with {_LINES}, {_occurrences('[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}')}{_placed('surface', having='count(distinct doc) >= 2')}")
def q06_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.names(document_lines(spark, sf_dir), by=index.placed)


@query(f"""with {_LINES}, t as (select unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) w from lines),
c as (select lower(w) word, count(*) filter (regexp_matches(w, '^[A-Z]{{2,}}$')) n_upper, count(*) filter (regexp_matches(w, '^[a-z]+$')) n_lower from t
where regexp_matches(w, '^[A-Z]{{2,}}$') or regexp_matches(w, '^[a-z]+$') group by 1)
select word, n_upper, n_lower from c where n_upper > 0 and n_lower >= n_upper""")
def q07_ordinary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.ordinary_words(document_lines(spark, sf_dir))


@query(f"with {_ROWS}, {_occurrences('[0-9]{4}-[0-9]{2}-[0-9]{2}')}{_placed('surface', where='try_cast(surface as date) is not null')}")
def q08_row_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dates(order_rows(spark, sf_dir), by=index.placed)


@query(rf"with {_ROWS}, {_occurrences(r'\$[0-9][0-9,]*(?:\.[0-9]+)?')}{_placed("replace(replace(surface, '$', ''), ',', '')::double")}")
def q09_row_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.amounts(order_rows(spark, sf_dir), by=index.placed)


@query(f"""with {_BLOCKS.replace(_LINES, _ROWS).replace('lines as (', 'lines as (', 1)}
select doc, min(line) first_line, max(line) last_line, count(*) n_blocks, sum(n_lines)::bigint n_lines from blocks group by doc""")
def q10_room_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sections.blocks(order_rows(spark, sf_dir))
    return own.groupBy("doc").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_blocks"), F.sum("n_lines").alias("n_lines"))


_STATUS = {"draft": ["F", "O"], "final": ["P"], "urgent": ["1-URGENT", "2-HIGH"]}


@query(rf"""with {_ROWS}, k as (select * from (values ('draft', '\b(?:F|O)\b'), ('final', '\b(?:P)\b'), ('urgent', '\b(?:1-URGENT|2-HIGH)\b')) v(status, p)),
f as (select doc, line, status, unnest(regexp_extract_all(text, p)) surface, unnest(range(1, len(regexp_extract_all(text, p)) + 1)) n from lines, k),
r as (select *, row_number() over (partition by doc, status order by line, n, surface) i from f)
select doc, status, line, surface from r where i = 1""")
def q11_status_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.status_claims(order_rows(spark, sf_dir), _STATUS)


@query("""with c as (select (o_orderkey // 3)::bigint identifier, o_custkey doc, case when o_orderstatus = 'F' then 'draft' else 'final' end status, o_orderdate::date as day from orders),
p as (select d.identifier, d.doc draft, f.doc final, d.day draft_day, f.day final_day from c d join c f on d.identifier = f.identifier and d.status = 'draft' and f.status = 'final' and d.day < f.day and d.doc <> f.doc),
a as (select draft, final, draft_day, final_day, min(identifier) identifier from (select *, count(*) over (partition by identifier) m from p) where m = 1 group by all),
t as (select doc from (select draft doc from a union all select final from a) group by doc having count(*) > 1)
select * from a where draft not in (select doc from t) and final not in (select doc from t)""")
def q12_version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "draft").otherwise("final")
    claims = o.select(F.expr("o_orderkey div 3").alias("identifier"), F.col("o_custkey").alias("doc"), status.alias("status"), F.to_date("o_orderdate").alias("day"))
    return index.version_pairs(claims)


@query("""with p as (select distinct user_id series, (extract(epoch from date_trunc('day', ts)) / 86400)::bigint period from events),
s as (select series, period, period - lag(period) over (partition by series order by period) step from p)
select series, min(step) step, count(*) n from s group by series having count(*) >= 3 and min(step) = max(step) and min(step) > 0""")
def q13_constant_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.unix_date(F.to_date("ts")).cast("long").alias("period")).distinct()
    return index.constant_steps(e)


_DAILY = 's as (select user_id series, ts::date as "at", round(sum(value), 4) as value from events group by 1, 2)'


def _turns(by: str) -> str:
    """Turning steps of table s in SQL, one row a series."""
    return f"""a as (select *, value - lag(value) over w step, row_number() over w n from s window w as (partition by {by} order by "at")),
m as (select {by}, quantile_cont(abs(step), 0.5) usual, count(*) length from a group by all having count(*) >= 5),
b as (select a.*, usual, lead(step) over w s2, lead(step, 2) over w s3 from a join m using ({by}) window w as (partition by {by} order by "at")),
t as (select *, row_number() over (partition by {by} order by n) r from b where step > usual and s2 > usual and s3 > usual or -step > usual and -s2 > usual and -s3 > usual)"""


@query(f"""with {_DAILY}, {_turns('series')}
select series, "at", n::int n, round(value, 6) as value, round(step, 6) step, round(usual, 6) usual from t where r = 1""")
def q14_turn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.turn_index(daily_events(spark, sf_dir, "user_id"))


@query(f"""with s as (select user_id series, event_type col, ts::date as "at", round(sum(value), 4) as value from events group by 1, 2, 3), {_turns('series, col')},
f as (select series, min(n) n from t where r = 1 group by 1), d as (select min(ts::date) + 8 as date from events), u as (select min(user_id) seed from events),
h as (select t.series, t.col, t."at" period from t join f using (series, n) join d on t."at" between date and date + 7 join u on t.series <> seed where r = 1),
l as (select h.series, count(*) n_left, round(sum(s.value), 4) left_behind from h join s on s.series = h.series and s.col = h.col and s."at" < h.period group by 1)
select h.series, min(period) period, any_value(n_left) n_left, any_value(left_behind) left_behind from h join l using (series) group by 1""")
def q15_series_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of users, a column for each type of event, that turn in the week that begins a week in."""
    e = table(spark, sf_dir, "events").withColumn("at", F.to_date("ts"))
    cells = e.groupBy(F.col("user_id").alias("series"), F.col("user_id").alias("doc"), F.col("event_type").alias("column"), "at").agg(F.round(F.sum("value"), 4).alias("value"))
    dates = e.agg(F.date_add(F.min("at"), 8).alias("date")).select(F.lit(1).alias("seed"), "date")
    broken, before = ranking.series_breaks(cells, dates, e.agg(F.min("user_id").alias("doc")).select(F.lit(1).alias("seed"), "doc"))
    sums = before.groupBy("series").agg(F.sum("n").alias("n_left"), F.round(F.sum("total"), 4).alias("left_behind"))
    return broken.join(sums, "series").select("series", "period", "n_left", "left_behind")


_CARRIED = "c as (select distinct 'identifier' kind, l_partkey::varchar as value, l_suppkey doc from lineitem)"
_EDGES = f"""{_CARRIED}, h as (select kind, value, count(*) carriers from c group by 1, 2 having count(*) between 2 and (select greatest(2, (count(*) * 0.5)::int) from supplier)),
e as (select a.doc a, b.doc b, a.kind, a.value, round(1.0 / carriers, 6)::double weight from c a join c b on a.kind = b.kind and a.value = b.value and a.doc < b.doc join h on h.kind = a.kind and h.value = a.value)"""
_NEAR = """twoway as (select a doc, b other, weight from e union all select b, a, weight from e),
near as (select doc, other, round(sum(weight), 6) weight from twoway group by 1, 2)"""


@query(f"with {_CARRIED} select kind, value, count(*) carriers, min(doc) first_doc from c group by 1, 2")
def q16_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_carriers(spark, sf_dir).groupBy("kind", "value").agg(F.count("*").alias("carriers"), F.min("doc").alias("first_doc"))


def _edges(spark: SparkSession, sf_dir: str, by_document: bool = True) -> DataFrame:
    most = graph.breadth(table(spark, sf_dir, "supplier").count())
    return graph.value_edges(part_carriers(spark, sf_dir), most, graph.KIND_WEIGHTS["identifier"], by_document)


@query(f"with {_EDGES} select a, b, kind, value, weight from e")
def q17_value_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, by_document=False)


@query("""with d as (select o_custkey doc, min(o_orderdate)::date as day from orders group by 1), s as (select distinct day as first from d), w as (select first, doc, day from s join d on day between first and first + 7),
h as (select first, count(distinct doc) population from w group by 1 having count(distinct doc) between 2 and (select greatest(2, count(*) // 2) from customer)),
p as (select w.first, w.doc, w.day, population, x.doc x from w join h on w.first = h.first join w x on x.first = w.first and x.day = x.first where w.doc <> x.doc),
r as (select least(doc, x) a, greatest(doc, x) b, first from_day, day to_day, round(0.9 / population, 6)::double weight,
 row_number() over (partition by least(doc, x), greatest(doc, x) order by round(0.9 / population, 6) desc, first, day) i from p)
select a, b, from_day, to_day, weight from r where i = 1""")
def q18_date_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the day of their first order; q18b has all their days."""
    o, most = table(spark, sf_dir, "orders"), graph.breadth(table(spark, sf_dir, "customer").count())
    days = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.to_date(F.min("o_orderdate")).alias("day"))
    # Customers have one day each, so that there are no more classes than days.
    members = links.written(graph.day_classes(days), "classes")
    return graph.class_pairs(members, links.written(graph.class_edges(members, most), "class-edges"), "from_day", "to_day", "weight")


@query("""with d as (select distinct o_custkey doc, o_orderdate::date as day from orders), s as (select distinct day as first from d), w as (select first, doc, day from s join d on day between first and first + 7),
h as (select first, count(distinct doc) population from w group by 1 having count(distinct doc) between 2 and (select greatest(2, count(*) // 2) from customer)),
p as (select w.first, w.doc, w.day, population, x.doc x from w join h on w.first = h.first join w x on x.first = w.first and x.day = x.first where w.doc <> x.doc),
r as (select least(doc, x) a, greatest(doc, x) b, first from_day, day to_day, round(0.9 / population, 6)::double weight,
 row_number() over (partition by least(doc, x), greatest(doc, x) order by round(0.9 / population, 6) desc, first, day) i from p)
select a, b, from_day, to_day, weight from r where i = 1""")
def q18b_date_edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, and windows of up to half of all customers."""
    o, most = table(spark, sf_dir, "orders"), graph.breadth(table(spark, sf_dir, "customer").count())
    return graph.date_edges(o.select(F.col("o_custkey").alias("doc"), F.to_date("o_orderdate").alias("day")), most)


@query(f"with {_EDGES}, {_NEAR} select doc, count(*) n_others, round(sum(weight), 6) degree from near group by doc")
def q19_adjacency_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.adjacency(_edges(spark, sf_dir)))


@query(f"""with {_EDGES}, {_NEAR}, m as (select doc, other, max(weight) weight from twoway group by 1, 2),
r as (select doc, weight, row_number() over (partition by doc order by weight desc, other) i from m)
select doc, round(sum(weight), 6) pull from r where i <= 3 group by doc order by pull desc, doc limit 25""")
def q20_seed_pull_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = graph.breadth(table(spark, sf_dir, "supplier").count())
    linked = graph.strongest_links(part_carriers(spark, sf_dir), most, graph.KIND_WEIGHTS["identifier"])
    return graph.pull(linked).orderBy(F.desc("pull"), "doc").limit(25)


@query(f"""with {_EDGES}, {_NEAR}, deg as (select doc, round(sum(weight), 6) degree from near group by doc),
d0 as (select other seed, doc, weight direct from near where other in (1, 2, 3)),
d1 as (select * from d0 union all select seed, seed, max(direct) * 1.5 from d0 group by seed),
d as (select seed, doc, direct / max(direct) over (partition by seed) nearness from d1),
s as (select d.seed, n.doc, sum(n.weight * d.nearness / deg.degree) spread from near n join d on n.other = d.doc join deg on deg.doc = d.doc group by 1, 2),
z as (select seed, doc, spread / max(spread) over (partition by seed) spread from s)
select coalesce(z.seed, d.seed) seed, coalesce(z.doc, d.doc) doc, round(coalesce(nearness, 0) + coalesce(z.spread, 0), 6) score from z full join d on z.seed = d.seed and z.doc = d.doc""")
def q21_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "doc long")
    carriers, most, weight = part_carriers(spark, sf_dir), graph.breadth(table(spark, sf_dir, "supplier").count()), graph.KIND_WEIGHTS["identifier"]
    direct = links.written(graph.seed_closeness(carriers, most, seeds, weight), "direct")
    return graph.scores_by_values(links.written(graph.carriers_beside(carriers, most, direct, weight), "held"), direct)


@query(f"""with {_EDGES}, r as (select *, row_number() over (partition by a, b order by weight desc, kind, value) i from e)
select a, b, string_agg(value, ', ' order by i) why from r where i <= 3 group by a, b""")
def q22_reasons_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reasons(_edges(spark, sf_dir))


_COMMON = ", ".join(f"'{w}'" for w in X.COMMON_WORDS)


def _content(what: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({what}), '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in ({_COMMON})))"


@query(f"""with h as (select doc_id anchor, unnest({_content('text')}) w from documents), k as (select item_id ask, unnest({_content('text')}) w from benchmark),
s as (select ask, anchor, count(*) shared from k join h using (w) group by 1, 2), r as (select *, row_number() over (partition by ask order by shared desc, anchor) i from s)
select ask, anchor, shared from r where i = 1""")
def q26_closest_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("anchor"), "text")
    return ranking.closest_section(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ask"), "text"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return verify.located(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote"), "text"), docs)


@query("select item_id as quote, doc_id doc, instr(d.text, b.text)::bigint as at from benchmark b join documents d on contains(d.text, b.text) where trim(b.text) <> ''")
def q27_quote_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir)


@query("""with f as (select distinct item_id from benchmark b where exists (select 1 from documents d where contains(d.text, b.text)))
select (select count(distinct item_id) from benchmark) n, count(*) n_found, round(100.0 * count(*) / (select count(distinct item_id) from benchmark), 2)::double recall from f""")
def q28_planted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlike q27, quotes of nothing or of spaces count as found where a text holds them."""
    facts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact"), "text")
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.col("text").alias("held"))
    blank = facts.where(F.trim("text") == "")
    seen = blank.select("text").distinct().join(texts.select(F.array_max(F.transform(F.concat(F.regexp_extract_all("held", F.lit(" +"), 0), F.array(F.lit(""))), F.length)).alias("n")).agg(F.max("n").alias("n"))).where(F.length("text") <= F.col("n"))
    found = _located(spark, sf_dir).select(F.col("quote").alias("fact")).unionByName(blank.join(seen, "text").select("fact"))
    return verify.recall(facts, found)


@query("""select lang, count(*) n, count(*) filter (toxic = 1) n_toxic, round(100 * avg((quality = 1)::int), 2)::double good_rate from documents join labels using (doc_id) group by lang""")
def q29_label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.round(100 * F.avg((F.col("quality") == 1).cast("int")), 2).alias("good_rate"))


@query(f"with {_CARRIED} select value, count(distinct doc) n from c group by value order by n, value limit 40")
def q31_rarest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rarest(part_carriers(spark, sf_dir))


@query("""with r as (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) rank, ceil(n_chars / 4)::bigint as cost from documents),
t as (select *, sum(cost) over (partition by source order by rank rows unbounded preceding) total from r)
select source, doc_id, rank::int rank, cost, total::bigint total from t where total <= 20000 or rank = 1""")
def q32_prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return ranking.choose(d.select("source", "doc_id", rank.alias("rank"), F.ceil(F.col("n_chars") / 4).alias("cost")), 20_000, ["source"]).select("source", "doc_id", "rank", "cost", "total")


@query("""with f as (select o_custkey doc, max(o_totalprice) as value from orders group by 1), g as (select o_custkey doc, max(o_orderkey) filter (o_totalprice = m) k from (select *, max(o_totalprice) over (partition by o_custkey) m from orders) group by 1)
select f.doc, f.value, min(o.o_orderkey) anchor from f join orders o on o.o_custkey = f.doc and o.o_totalprice = f.value group by 1, 2""")
def q33_largest_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return ranking.largest_per_doc(o.select(F.col("o_custkey").alias("doc"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("anchor")))


@query("""with s as (select o_orderkey k, 60 as "days", o_orderdate::date as day from orders where o_orderpriority = '1-URGENT'), a as (select l_orderkey k, min(l_shipdate)::date done_day from lineitem group by 1)
select k as "key", "days", day, done_day, datediff('day', day, done_day)::int - "days" late from s join a using (k) where datediff('day', day, done_day) > "days" """)
def q34_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"), F.lit(60).alias("days"), F.to_date("o_orderdate").alias("day"))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.to_date("l_shipdate").alias("day"))
    return ranking.stated_against_done(stated, done)


@query("""with r as (select o_orderpriority g, o_orderkey k, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) turn from orders),
f as (select * from r order by turn, g limit 60) select g as priority, k as o_orderkey, turn::int turn, row_number() over (order by turn, g)::int place from f""")
def q37_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderkey", "o_totalprice")
    return ranking.round_robin(o, "priority", [F.desc("o_totalprice"), F.col("o_orderkey")], 60).select("priority", "o_orderkey", "turn", "place")


@query(f"""with {_LINES}, c as (select doc_id id, case when doc_id % 3 = 0 then 'none' when doc_id % 3 = 1 then doc_id || '#l1' else (doc_id + 500) || '#l' || (doc_id % 7) end citation from documents),
p as (select *, regexp_extract(citation, '^(.+)#l[0-9]+$', 1) doc from c)
select id, citation, case when doc = '' then 'no citation' when doc not in (select doc_id::varchar from documents) then 'no such document' else 'no such line' end reason from p
where doc = '' or doc not in (select doc_id::varchar from documents) or citation not in (select doc || '#l' || line from lines)""")
def q39_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, id_ = table(spark, sf_dir, "documents"), F.col("doc_id")
    citation = F.when(id_ % 3 == 0, F.lit("none")).when(id_ % 3 == 1, X.line_anchor(id_, F.lit(1))).otherwise(X.line_anchor(id_ + 500, id_ % 7))
    anchors = document_lines(spark, sf_dir).select(X.line_anchor(F.col("doc"), F.col("line")).alias("anchor"))
    return verify.failed_citations(d.select(id_.alias("id"), citation.alias("citation")), anchors, d.select(id_.alias("doc")))


_NUMBERS = "list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:[.][0-9]+)?'), lambda x: replace(x, ',', '')))"


@query(f"""with {_ROWS}, said as (select line id, doc + 1 doc, unnest({_NUMBERS}) number from lines), held as (select distinct doc, unnest({_NUMBERS}) number from lines)
select id, number from said s where not exists (select 1 from held h where h.doc = s.doc and h.number = s.number)""")
def q40_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_rows(spark, sf_dir)
    return verify.unsupported_numbers(rows.select(F.col("line").alias("id"), (F.col("doc") + 1).alias("doc"), "text"), rows.select("doc", "text"))


def _rung(k: int) -> str:
    return rf"regexp_matches(lower(text), '\b(?:{'|'.join(verify.RUNGS[k])})\b')"


def _rung_sql(column: str) -> str:
    return f"case {' '.join(f'when {_rung(k).replace("lower(text)", f"lower({column})")} then {k + 1}' for k in (2, 1, 0))} else 0 end"


@query(f"""with c as (select o_orderkey id, case o_orderpriority when '1-URGENT' then 'A confirmed order' when '2-HIGH' then 'Probable, and expected' when '3-MEDIUM' then 'It MAY ship' else 'An order' end said,
 case o_orderstatus when 'F' then 'It is certain' when 'O' then 'an estimated day' else 'mayhem' end held from orders),
r as (select id, {_rung_sql('said')}::int rung, {_rung_sql('held')}::int held from c)
select id, rung, held from r where rung > held""")
def q41_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sentences, more or less certain by priority, that cite sections more or less certain by status."""
    priority, status, o = F.col("o_orderpriority"), F.col("o_orderstatus"), table(spark, sf_dir, "orders")
    said = F.when(priority == "1-URGENT", "A confirmed order").when(priority == "2-HIGH", "Probable, and expected").when(priority == "3-MEDIUM", "It MAY ship").otherwise("An order")
    held = F.when(status == "F", "It is certain").when(status == "O", "an estimated day").otherwise("mayhem")
    found = verify.too_certain(o.select(F.col("o_orderkey").alias("id"), said.alias("text"), F.col("o_orderkey").alias("anchor")), o.select(F.col("o_orderkey").alias("anchor"), held.alias("text")))
    return found.select("id", "rung", "held")


@query("""with o as (select *, 'C' || o_custkey || '.md#l' || o_orderkey anchor, '$' || round(o_totalprice / 1000)::bigint || ',000' price, (200 + o_orderkey % 700)::varchar pallets from orders)
select o_orderkey id, anchor, 'Harbor shipment of ' || pallets || ' pallets cost ' || price || ' after delays' finding from o
where o_orderstatus = 'P' or o_orderstatus = 'O' and o_orderpriority in ('4-NOT SPECIFIED', '5-LOW')""")
def q42_uncarried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings, against paragraphs with their anchors: done orders are written whole, in two paragraphs;
    of open ones the less urgent lack words, and pending ones have no paragraph.
    """
    o = table(spark, sf_dir, "orders")
    anchor = F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(".md#l"), F.col("o_orderkey").cast("string"))
    price = F.concat(F.lit("$"), F.round(F.col("o_totalprice") / 1000).cast("long").cast("string"), F.lit(",000"))
    pallets = (200 + F.col("o_orderkey") % 700).cast("string")
    finding = F.concat(F.lit("Harbor shipment of "), pallets, F.lit(" pallets cost "), price, F.lit(" after delays"))
    findings = o.select(F.col("o_orderkey").alias("id"), anchor.alias("anchor"), finding.alias("finding"))
    cite = F.concat(F.lit(" [C"), F.col("o_custkey").cast("string"), F.lit(" | "), anchor, F.lit("]."))
    loose = F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")
    said = F.when(F.col("o_orderstatus") == "F", F.array(F.concat(F.lit("The harbor shipment cost "), F.replace(price, F.lit(","), F.lit("")), cite), F.concat(F.lit("It had "), pallets, F.lit(" pallets"), cite)))
    said = said.when((F.col("o_orderstatus") == "O") & loose, F.array(F.concat(F.lit("It was "), pallets, F.lit(" at "), price, cite))).when(F.col("o_orderstatus") == "O", F.array(F.concat(finding, cite)))
    return verify.uncarried(findings, o.select(F.explode(said).alias("text")))


@query("""with b as (select conv_id, turn, role, text, len(string_split(text, chr(10))) n from conversations)
select conv_id, turn, unnest([n + 1, n + 2])::bigint line, unnest(['From: ' || role, 'Subject: conversation ' || conv_id]) as text from b""")
def q44_mail_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of a message are numbered after its body."""
    c = table(spark, sf_dir, "conversations")
    headers = F.array(F.concat(F.lit("From: "), "role"), F.concat(F.lit("Subject: conversation "), F.col("conv_id").cast("string")))
    return c.select("conv_id", "turn", F.size(F.split("text", "\n")).alias("n"), F.posexplode(headers).alias("pos", "text")).select("conv_id", "turn", (F.col("n") + F.col("pos") + 1).cast("long").alias("line"), "text")


@query("""select event_type, event_id, round(1000000 - sum(value) over (partition by event_type order by ts, event_id rows unbounded preceding), 6) balance from events""")
def q45_running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("value").alias("amount"))
    return ranking.running_balance(e, 1_000_000, "event_type").select("event_type", F.col("id").alias("event_id"), "balance")


@query(f"""with recursive {_LINES}, s as (select doc, line, length(text)::bigint n from lines),
p as (select doc, line, n chars, 1::bigint piece from s where line = 1
 union all select s.doc, s.line, case when p.chars + 1 + s.n <= 2000 then p.chars + 1 + s.n else s.n end, case when p.chars + 1 + s.n <= 2000 then p.piece else p.piece + 1 end from p join s on s.doc = p.doc and s.line = p.line + 1)
select doc, piece, min(line) "first", max(line) "last", count(*) n_sections, max(chars) chars from p group by doc, piece""")
def q47_packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.packed_pieces(document_lines(spark, sf_dir), 2000)


@query("select event_type, ts::date as day, count(*) n, round(sum(value), 4) as value from events group by 1, 2")
def q49_daily_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress(table(spark, sf_dir, "events")).select("event_type", F.to_date("start").alias("day"), "n", "value")


def _kept(what: str) -> str:
    return f"list_filter(regexp_extract_all(lower({what}), '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in ({_COMMON}))"


_RUN3 = "list_distinct(list_transform(range(1, greatest(len(k) - 1, 1)), lambda i: array_to_string(k[i:i+2], ' ')))"


@query(f"""with kl as (select item_id a, {_kept('text')} k from benchmark), kr as (select doc_id b, {_kept('text')} k from documents),
l as (select a, unnest({_RUN3}) run from kl), r as (select b, unnest({_RUN3}) run from kr),
s as (select a, b, count(*) shared from l join r using (run) group by 1, 2)
select a as item_id, min(b) doc_id, arg_min(shared, b) shared from s group by a""")
def q25_shared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("b"), "text")
    return ranking.shared_runs(items, docs, X.word_runs(F.col("text"), 3)).select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), "shared")


@query(rf"""with {_LINES}, k as (select doc, line, trim(regexp_replace(text, '\s+', ' ', 'g')) folded from lines),
r as (select *, row_number() over (partition by doc, folded order by line) i from k where folded <> '')
select doc, line, folded from r where i = 1""")
def q30_distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = document_lines(spark, sf_dir).select("doc", "line", X.collapsed(F.col("text")).alias("folded")).where("folded <> ''")
    return ranking.first_of_each(folded, ["doc", "folded"], ["line"])


@query("""with s as (select s_nationkey k, count(*) n, max(s_acctbal) most from supplier group by 1), c as (select c_nationkey k, count(*) n, max(c_acctbal) most from customer group by 1)
select s.k supplier_nation, c.k customer_nation, s.most supplier_most, c.most customer_most from s join c on s.k <> c.k and c.most > s.most join nation n on n.n_nationkey = s.k join nation m on m.n_nationkey = c.k where n.n_regionkey = m.n_regionkey""")
def q36_opposed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest figures of one side held against larger ones of the other, within a region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")

    def side(name: str, key: str, value: str, as_: str) -> DataFrame:
        own = table(spark, sf_dir, name).groupBy(F.col(key).alias(f"{as_}_nation")).agg(F.max(value).alias(f"{as_}_most"))
        return own.join(nation, F.col(f"{as_}_nation") == F.col("n_nationkey")).select(f"{as_}_nation", f"{as_}_most", F.col("n_regionkey").alias("region"))

    both = side("supplier", "s_nationkey", "s_acctbal", "supplier").join(side("customer", "c_nationkey", "c_acctbal", "customer"), "region")
    return both.where("supplier_nation <> customer_nation and customer_most > supplier_most").drop("region")


@query("""with r as (select o_custkey doc, o_orderkey anchor, o_totalprice as value, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rank from orders)
select doc, anchor, value, rank::int rank from r where rank <= 3""")
def q38_figures_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("anchor"), F.col("o_totalprice").alias("value"))
    return ranking.top_per_group(o, "doc", [F.desc("value"), F.col("anchor")], 3)


_PARTS = r"string_split(regexp_replace(html, '<h([1-6])([ >])', chr(1) || '\1\2', 'g'), chr(1))"


@query(rf"""with p as (select page_id, unnest({_PARTS}) part, unnest(range(1, len({_PARTS}) + 1))::int n from pages)
select page_id, n, length(part)::bigint chars, regexp_extract(part, '^([1-6])[ >]', 1) as level from p""")
def q43_page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut at their headings."""
    cut = F.split(F.regexp_replace("html", "<h([1-6])([ >])", "\u0001$1$2"), "\u0001")
    parts = table(spark, sf_dir, "pages").select("page_id", F.posexplode(cut).alias("pos", "part"))
    return parts.select("page_id", (F.col("pos") + 1).cast("int").alias("n"), F.length("part").cast("long").alias("chars"), F.regexp_extract("part", "^([1-6])[ >]", 1).alias("level"))


@query("""with s as (select o_custkey seed, count(*) n, max(o_totalprice) most from orders where o_orderpriority = '1-URGENT' group by 1),
e as (select c_custkey seed, c_acctbal pull, coalesce(n, 0) n, coalesce(most, 0) most from customer left join s on s.seed = c_custkey)
select seed, n, most, row_number() over (order by n desc, most desc, pull desc, seed)::int place from e qualify place <= 25""")
def q46_consequence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as matters, their urgent orders as consequences; the first 25 by number, money and balance."""
    o = table(spark, sf_dir, "orders")
    consequences = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("seed"), F.col("o_orderkey").alias("doc"))
    money = links.money_carried(o.select(F.col("o_orderkey").alias("doc"), F.col("o_totalprice").alias("value"), F.lit("USD").alias("unit")))
    return links.ranked_matters(consequences, money, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed"), F.col("c_acctbal").alias("pull")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of documents grown from the strongest seeds."""
    return QUERIES["q71_room_map"](spark, sf_dir)
