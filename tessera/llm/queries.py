"""The opN queries over the whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._tables import shared_dir, table, tuned
from tessera.llm.chat import format_chats, repaired_turns
from tessera.llm.decontaminate import decontaminate
from tessera.llm.html_text import extract_text
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.neighbours import nearest
from tessera.llm.packing import pack
from tessera.llm.quality import judge_quality
from tessera.llm.repeats import remove_repeats
from tessera.llm.resampling import resample
from tessera.llm.sharding import shuffle_into_shards
from tessera.llm.toxicity import held_out, score_toxicity
from tessera.llm.url_filters import filter_urls
from tessera.llm.whitening import fit, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tuned(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = jaccard_join(table(spark, sf_dir, "documents"), n_words=4, percent=85)
    return members.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


SQL["op2_jaccard_join"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) end) g from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 85 * (a.n + b.n - k)),
e as (select x, y from l union all select y, x from l),
r as (select x node, x other from e union select r.node, e.y from r join e on e.x = r.other),
c as (select node, min(other) component_id from r group by node)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.component_id, d.doc_id) component_id
from documents d left join n on n.doc_id = d.doc_id left join c on c.node = d.doc_id
"""


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op3_decontaminate"] = r"""
with b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
p as (
  select distinct item_id, least(len(ws), 10) n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i+9], ' '))) g from b where len(ws) > 0),
d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
k as (select distinct n from p),
w as (
  select doc_id, n, unnest(range(1, len(ws) - n + 2)) i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i+n-1], ' '))) g from d, k where len(ws) >= n),
h as (select w.doc_id, w.i, w.n, p.item_id from w join p on p.n = w.n and p.g = w.g),
t as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from h) group by doc_id),
m as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) s from (select distinct doc_id, item_id::varchar x from h) group by doc_id)
select d.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join t on t.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""


@query
def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


@query
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(pack(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN))


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("queue").alias("source"), "window")


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host_col="source", path_col="lang").withColumnRenamed("id", "doc_id")


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    judged = filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), rules)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.array_join("mined", " ").alias("mined"))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_text(table(spark, sf_dir, "pages"))
    return texts.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex[:12]}"
    text = F.coalesce("text", F.lit(""))
    shuffled = shuffle_into_shards(table(spark, sf_dir, "documents"), path, shards=8)
    return shuffled.select(
        F.col("id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repaired_turns(format_chats(table(spark, sf_dir, "conversations")))
    return turns.select(F.col("conv").alias("conv_id"), F.col("block.wide").alias("block"), F.col("block.turn").alias("block_turn"), F.col("block.part").alias("block_part"), "place", "role", "text", "continues", "cost")


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL["op11_resample"] = r"""
with recursive k as (select i, (i)::bigint v, 0 r from range(256) t(i)
  union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, r + 1 from k where r < 8),
step as (select i, v from k where r = 8),
w as (
  select 's' side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents
  union all select 't', null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
f as (
  select side, doc_id, unnest(ws) g from w
  union all select side, doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1])) from w
  union all select side, doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) from w),
d as (select g, hex(encode(g)) x from (select distinct g from f)),
c as (select g, x, 0 k, 4294967295::bigint s from d
  union all select c.g, c.x, c.k + 1, xor(step.v, c.s >> 8) from c join step on step.i = xor(c.s & 255, ('0x' || substr(c.x, 2 * c.k + 1, 2))::bigint) where 2 * c.k < length(c.x)),
b as (select g, xor(s, 4294967295) % 10000 b from c where 2 * k = length(x)),
n as (select b, count(*) filter (side = 's') s, count(*) filter (side = 't') t from f join b using (g) group by b),
total as (select sum(s)::double s, sum(t)::double t from n),
gain as (select b, floor(1000 * ln((n.t + 1.0::double) * (total.s + 10000) / ((n.s + 1.0::double) * (total.t + 10000))))::bigint v from n, total),
own as (select doc_id, count(*) n_features, sum(v)::bigint weight from f join b using (g) join gain using (b) where side = 's' group by doc_id),
scored as (
  select w.doc_id, len(ws) n_words, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
  from w left join own on own.doc_id = w.doc_id where side = 's'),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) r, count(*) over () n from scored where n_words >= 20)
select s.doc_id, n_features, weight, score, case when r <= n * 5 // 100 then r end::bigint as rank
from scored s left join ranked using (doc_id)
"""


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score_toxicity(table(spark, sf_dir, "documents"), training)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages")


@query
def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = fit(vectors)
    numbers = lambda x: F.array(*(F.lit(float(v)) for v in x))
    shares = numbers(model.explained if model else [])
    rows = whiten(vectors, model).select("*", F.posexplode("whitened").alias("place", "white"))
    return rows.select(
        F.col("id").alias("vec_id"),
        (F.col("place") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        F.col("white").alias("whitened"),
        F.get(shares, F.col("place")).cast("double").alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
