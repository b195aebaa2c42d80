"""Main text of web pages by tag-path ratios.

A text node's tag path is the chain of block elements from the root to it,
with their classes but without ids, which vary.  For all pages of a host, text
length, punctuation and link text are added up per path, and taken per page
that has the path.  They are smoothed over the tree: a path's text and that of
its richest container (what stands directly in one of the elements around it,
half as much for each further step out) are averaged and fused into one score,
so that a heading or a list belongs with the paragraphs beside it, and a
line of its own between containers does not.  Paths below a share of the
host's best are dropped.  What a page says about itself is evidence that raises
or lowers the score: text within an article or main element needs less, and
each element around it that is named as navigation, aside, footer, form,
advert, notice or comments divides it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import BROADCAST_KEYS, own_columns, staged
from tessera.llm.url_filters import url_host

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select button head".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot body html legend summary figcaption li dd dt".split())
CHROME = frozenset("nav aside footer form menu dialog".split())
# Words in class, id and role that mark what is not the article.
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts alert aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer form gdpr legal login menu modal nav navbar navigation newsletter notice notification pager pagination popup promo related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Words of these that are other people's text even if it comes in articles.
OTHERS_WORDS = frozenset("ad ads advert comment comments disqus promo related respond sponsored".split())
# Words that make a class name tell of the layout or of a state, not of the element's own kind.
STATE_WORDS = frozenset("closed container content disabled enabled has is layout no off on one open page site two with without wrap wrapper".split())
# Elements that do not begin a path of their own.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CONTENT = frozenset(("article", "main"))
#: What text within content is worth, and text within each element named as chrome.
CONTENT_WORTH, CHROME_WORTH = 4.0, 0.05
#: A path stays if its fused score is at least this share of the host's best.
THRESHOLD = 0.1
#: What a container counts for each step that it is further out, and how far out one is looked for.
FURTHER_OUT, STEPS_OUT = 0.5, 8

# A quote that does not close before the next tag is a stray one and holds nothing back.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


def _place(tag: str, attributes: str, inside: bool) -> tuple[str, int, bool]:
    """An element's step in the path, whether it is named as chrome (1 by a word, 2 by its element), and whether it is content."""
    names, words, said = set(), set(), set()
    if attributes and "=" in attributes:
        for m in _NAMED.finditer(attributes):
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                parts = _WORDS.findall(token)
                words.update(parts)
                if m[1].lower() != "id":
                    names.update(x for x in parts if x.isalpha())
                if not STATE_WORDS.intersection(parts):
                    said.update(parts)
    step = f"{tag}.{'.'.join(sorted(names))}" if names else tag
    if tag in ("html", "body"):
        return step, 0, False
    content = tag in CONTENT or "main" in words
    if tag in CHROME or tag == "header" and not inside or _HIDDEN.search(attributes or ""):
        return step, 2, content
    marked = said & (OTHERS_WORDS if content else CHROME_WORDS) or "header" in said and tag != "header" and not inside and not content
    return step, int(bool(marked)), content


def text_nodes(page: str) -> list[tuple[str, int, int, bool, str]]:
    """(path, zone, block, in a link, raw text) of the text nodes outside scripts, styles and the like, in order.

    The zone is 1 within content, 0 elsewhere, or minus the number of elements
    around the text that are named as chrome.  A word does not mark what holds the
    main element, nor (but for comments and the like) what holds an article.
    """
    nodes, gone = _walked(page)
    out = []
    for path, (inside, marks), block, link, text in nodes:
        n = sum(1 for m in marks if m not in gone)
        zone = -min(n, 3) if n else int(inside)
        out.append((f"{path}#{zone}", zone, block, link, text))
    return out


def _walked(page: str) -> tuple[list[tuple], set[int]]:
    nodes: list[tuple] = []
    # Of each open element: name, path, (within content, numbers of the marked elements around), in a link.
    stack: list[tuple[str, str, tuple, bool]] = [("", "", (False, ()), False)]
    marked: list[int] = []  # of each marked element: 0 by its element, 1 by a word, 2 by a word for other people's text
    cleared: set[int] = set()
    at, block = 0, 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            _, path, zone, link = stack[-1]
            nodes.append((path, zone, block, link, html.unescape(text)))
        if not m:
            return nodes, cleared
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            block += 1
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at) if not (m[3] or "").rstrip().endswith("/") or tag in ("script", "style", "title", "textarea") else None
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                return nodes, cleared
            continue
        if tag == "br" or tag in VOID:
            if tag == "br" and nodes:
                nodes.append((*stack[-1][1:3], block, stack[-1][3], " "))
            continue
        if tag in CLOSES_P or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            gone = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("p",))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in gone:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        _, path, (inside, marks), link = stack[-1]
        step, kind, content = _place(tag, m[3], inside)
        if not (m[3] or "").endswith("/") or tag in BLOCK:
            if content and not kind:
                cleared.update(k for k in marks if marked[k] == 1 or marked[k] == 2 and tag == "main")
            if kind:
                marks = (*marks, len(marked))
                marked.append(0 if kind == 2 else 2 if OTHERS_WORDS.intersection(_WORDS.findall((m[3] or "").lower())) else 1)
            stack.append((tag, path if tag in INLINE else f"{path}/{step}", (inside or content, marks), link or tag == "a"))


_NODES = "id long, url string, host string, nodes array<struct<path:string,zone:int,block:int,link:boolean,text:string,first:boolean>>"
_PUNCTUATION = r"[^.,;:!?。、,!?;:…¡¿]"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("path", pa.string()), ("zone", pa.int32()), ("block", pa.int32()), ("link", pa.bool_()), ("text", pa.string()), ("first", pa.bool_())]))
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            pages = []
            for page in part.column("html").to_pylist():
                seen: set[str] = set()
                own = []
                for p, z, b, a, t in text_nodes(page or ""):
                    fresh = bool(t.strip(" ")) and p not in seen
                    if fresh:
                        seen.add(p)
                    own.append({"path": p, "zone": z, "block": b, "link": a, "text": t, "first": fresh})
                pages.append(own)
            yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), part.column("url"), part.column("host"), pa.array(pages, kind)], names=["id", "url", "host", "nodes"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, blocks = [], []
        for nodes, kept in zip(batch.column("nodes").to_pylist(), batch.column("kept").to_pylist(), strict=True):
            kept = set(kept or ())
            parts: dict[int, list[str]] = {}
            for n in nodes:
                if n["path"] in kept:
                    parts.setdefault(n["block"], []).append(n["text"])
            lines = [line for b in sorted(parts) if (line := " ".join("".join(parts[b]).split()))]
            texts.append("\n".join(lines))
            blocks.append(len(lines))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(blocks, pa.int64())], names=["id", "url", "text", "n_blocks"])


def path_scores(parsed: DataFrame) -> DataFrame:
    """host, path, score, worth (what names make of it), best (the host's best score, names that lower it counted).

    All is by grouped sums and joins on host and path, so that a host of any size is spread over tasks.
    """
    nodes = parsed.select("host", F.explode("nodes").alias("node")).where(F.trim("node.text") != "")
    stats = nodes.groupBy("host", F.col("node.path").alias("path"), F.col("node.zone").alias("zone")).agg(
        F.count_if("node.first").alias("pages"), F.sum(F.length("node.text")).alias("chars"), F.sum(F.length(F.regexp_replace("node.text", _PUNCTUATION, ""))).alias("points"), F.sum(F.when(F.col("node.link"), F.length("node.text")).otherwise(0)).alias("linked")
    )
    stats = staged(stats.withColumn("by_text", F.col("chars") / F.col("pages")).withColumn("by_points", F.col("points") / F.col("pages")), "paths")
    # The elements around a path, nearest first, as paths of their own.
    steps = F.split(F.regexp_replace("path", "#-?[0-9]+$", ""), "/")
    around = F.transform(F.sequence(F.lit(1), F.least(F.size(steps) - 1, F.lit(STEPS_OUT))), lambda k: F.struct(F.array_join(F.slice(steps, F.lit(1), F.size(steps) - k), "/").alias("element"), F.pow(F.lit(FURTHER_OUT), k - 1).alias("weight")))
    out = stats.where(F.size(steps) > 1).select("host", "path", "by_text", "by_points", F.explode(around).alias("a")).select("host", "path", "by_text", "by_points", "a.element", "a.weight")
    direct = out.where("weight = 1").groupBy("host", "element").agg(F.sum("by_text").alias("text"), F.sum("by_points").alias("points"))
    held = out.select("host", "path", "element", "weight").join(direct, ["host", "element"]).groupBy("host", "path").agg(F.max(F.col("weight") * F.col("text")).alias("around_text"), F.max(F.col("weight") * F.col("points")).alias("around_points"))
    fused = stats.join(held, ["host", "path"], "left")
    # Headings have no punctuation of their own, so that of the container is averaged in; length has to be there in both.
    text = F.sqrt(F.col("by_text") * F.coalesce("around_text", "by_text"))
    points = (F.col("by_points") + F.coalesce("around_points", "by_points")) / 2
    score = F.sqrt(text * (points + 0.1)) * (1 - F.col("linked") / F.col("chars"))
    worth = F.when(F.col("zone") > 0, F.lit(CONTENT_WORTH)).otherwise(F.pow(F.lit(CHROME_WORTH), -F.col("zone")))
    scored = fused.select("host", "path", score.alias("score"), worth.alias("worth"))
    # The bar is set by the best path as it is, not by what content is worth beyond that.
    best = scored.groupBy("host").agg(F.max(F.col("score") * F.least("worth", F.lit(1.0))).alias("best"))
    return scored.join(best, "host")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """The main text of each page: its blocks in order, one per line.

    Returns one row per input row: id, url, text, n_blocks.  A null, empty or
    markup-only page has an empty text.  Character references are decoded once;
    white space within a block becomes one space.  A null url, or one without
    host, is of the host ''.  Null ids and repeated rows are kept.  Text outside
    any element counts as a path of its own.  Other columns are ignored.
    """
    source = own_columns(pages, id=id_col, url=url_col, html=html_col)
    parsed = staged(source.select("id", "url", url_host(F.col("url")).alias("host"), "html").mapInArrow(_parsed, _NODES), "nodes")
    kept = path_scores(parsed).where((F.col("score") * F.col("worth") >= threshold * F.col("best")) & (F.col("score") > 0))
    kept = staged(kept.select("host", "path"), "kept")
    if kept.count() <= BROADCAST_KEYS // 10:
        lists = kept.groupBy("host").agg(F.collect_list("path").alias("kept")).select(F.col("host").alias("of"), "kept")
        with_kept = parsed.join(F.broadcast(lists), F.col("host") == F.col("of"), "left")
    else:  # a page's own paths meet the kept ones, so that no host's are gathered
        keyed = parsed.withColumn("key", F.xxhash64("id", "url", "nodes"))
        own = keyed.select("key", "host", F.explode("nodes.path").alias("path")).distinct().join(kept, ["host", "path"])
        with_kept = keyed.join(own.groupBy("key").agg(F.collect_list("path").alias("kept")), "key", "left")
    return with_kept.select("id", "url", "nodes", "kept").mapInArrow(_joined, "id long, url string, text string, n_blocks long")
