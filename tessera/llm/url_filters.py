"""URL filters by association rules.

URLs are baskets of tokens: scheme, host labels, path segments, file endings,
query keys.  Spark's FP-growth mines, from labelled URLs, the combinations of
tokens that go with bad pages.  Rules that reach a least support (a share of
the labelled URLs, and a number of them), confidence and lift are kept, a longer one only if it is surer than any rule it contains.
They are matched by inverted index: a rule lies under its rarest token, and a
URL is compared only with the rules under its own tokens.  Fixed rules by host
and path come before the mined ones.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import BROADCAST_KEYS, own_columns, staged

_BAD = "label=bad"
#: Labelled URLs that must have all tokens of a rule and be bad, however few there are.
LEAST_ROWS = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL; numbers count as one token."""
    host, path = url_host(url), url_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    named = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_distinct(
        F.concat(
            named("scheme=", F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
            named("host=", F.split(host, r"\.")),
            named("path=", F.split(path, "/")),
            named("ending=", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)/?$", 1))),
            named("query=", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))),
        )
    )


def mine_rules(urls: DataFrame, least_support: float = 0.002, least_confidence: float = 0.6, least_lift: float = 1.5, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Rules (tokens, confidence, support, lift) from labelled URLs (url, bad).

    Rows with a null url or label are left out; repeated rows count each time.
    Fewer labelled URLs than least_rows give no rules.
    """
    named = staged(urls.where("url is not null and bad is not null").select(F.concat(url_tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array())).alias("items")), "baskets")
    n = named.count()
    if n < max(least_rows, 1):
        return named.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double, lift double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(least_support, (least_rows - 0.5) / n)), minConfidence=least_confidence).fit(named)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(_BAD))).where(F.col("lift") >= least_lift)
    rules = staged(rules.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support", "lift"), "rules")
    # A rule goes if a shorter one within it is as sure.  Shorter rules are found by leaving out one token at a time.
    shorter = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).select("tokens", "confidence", F.array_remove("tokens", F.col("token")).alias("part"))
    better = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"))
    weak = shorter.join(better, "part").where("sure >= confidence").select("tokens").distinct()
    return staged(rules.join(weak, "tokens", "left_anti"), "rules")


def _fixed(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", **mining: float) -> DataFrame:
    """Verdicts on URLs: fixed rules first (the longest that fits), mined ones for the rest.

    rules: (allow or block, host/path).  Returns one row per input row: id,
    host, path, rule (null if none fits), verdict, mined (tokens of the surest
    matching mined rule), confidence.  A URL that no rule matches is allowed.

    A page is bad if its label says poor or toxic.  A null URL, or one without
    `://`, has an empty host and path and is judged like others.  Null ids are
    kept, repeated rows judged alike.  Other columns are ignored.
    """
    source = own_columns(pages, id=id_col, url=url_col)
    marks = own_columns(labels, id=label_id, quality=quality_col, toxic=toxic_col).select("id", ((F.col("quality") == 0) | (F.col("toxic") > 0)).alias("bad"))
    mined = mine_rules(source.join(marks, "id").select("url", "bad"), **mining)

    urls = source.select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    tokens = mined.select(F.explode("tokens").alias("token")).distinct()
    spread = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(tokens) if tokens.count() <= BROADCAST_KEYS else tokens, "token").groupBy("token").agg(F.count("*").alias("spread"))
    index = mined.select("tokens", "confidence", F.explode("tokens").alias("token")).join(spread, "token").groupBy("tokens", "confidence").agg(F.min(F.struct("spread", "token")).alias("rarest"))
    index = staged(index.select(F.col("rarest.token").alias("token"), F.col("tokens").alias("mined"), "confidence"), "index")
    index = F.broadcast(index) if index.count() <= BROADCAST_KEYS // 10 else index
    matched = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("mined", "tokens")) == 0)
    matched = matched.groupBy("url").agg(F.max(F.struct("confidence", "mined")).alias("best"))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = source.join(matched, "url", "left").select("id", host.alias("host"), path.alias("path"), F.col("best.mined").alias("mined"), F.col("best.confidence").alias("confidence"))
    rule, verdict = _fixed(rules, F.col("host"), F.col("path"))
    return judged.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined", "confidence")
