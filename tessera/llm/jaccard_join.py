"""N-gram Jaccard join by prefix filters under several global token orders.

A text's tokens are its distinct word shingles.  If two sets of sizes a and b
reach the threshold t, then under *any* global order of all tokens the first
floor((1 - t) * a) + 1 tokens of one and the first floor((1 - t) * b) + 1 of
the other have a token in common.  The join therefore takes as candidates the
pairs that share such a prefix token under a first order, keeps those that
share one under a second and a third, independent order too, and verifies what
is left on the whole texts.

The plan, and what keeps it bounded:

* Texts with the same set are one class, represented by its smallest id.
  Copies never meet each other again.
* A pair is made under its first common token only: what stands behind it in
  both sets, and their sizes, must allow the similarity.
* Short posting lists are expanded into pairs.  In a long one every member is
  compared with its smallest member and a few others chosen by hash (stars).
  Lists whose members are then all in one component are done, as nothing more
  could be learnt.  In the others the members outside the largest component
  meet all members, across components alone, and a pair is made only if the
  sketches allow it; where there are many outside, the list is first split by
  the prefix tokens of the second order, and then of the third.
* Tokens that very many texts have come last in all orders, so that a
  passage shared by unrelated texts seldom reaches a prefix.
* Candidate pairs carry ids and sizes.  Parity sketches, then prefixes of the
  other orders, then texts join them, each for the pairs that are left.

The reported links are the ones that were verified: between different texts
of one component not every pair is listed, but the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import discard, only, own_columns, staged
from tessera.llm._text import U, mix, shingle_sets
from tessera.llm.components import components

#: Posting lists up to this length are expanded; longer ones have so many stars each.
SHORT_LIST, STARS = 8, 3
#: A list with more members than this outside its largest component is split by another order before it is expanded.
LONG_LIST = 4096
#: The orders after the first are those of these hashes of tokens.
_ORDERS = {"second": U(0x8CB92BA72F3D8DD7), "third": U(0x2545F4914F6CDD1D)}

#: A set's parity sketch is so many 64-bit words: bit k says whether an odd
#: number of its tokens fall on k.  Two sketches differ in at most as many bits
#: as the sets have tokens that only one of them has.
SKETCH = 16
_BITS = [f"b{k}" for k in range(SKETCH)]
_SETS = "id long, n long, c1 long, c2 long, first array<long>, second array<int>, third array<int>, " + ", ".join(f"{b} long" for b in _BITS)


#: Cells of the table of token frequencies, and texts from which a token counts as frequent.
CELLS = 1 << 23
FREQUENT = 24
#: Texts after which a task hands on what it has counted (16 bits hold them).
_COUNTED = 60_000


def _frequencies(n_words: int):
    """Cells that a task saw more often than chance fills them, and how often."""

    def counted(seen: np.ndarray, total: int) -> pa.RecordBatch:
        cells = np.flatnonzero(seen >= 2 + max(0, int(np.ceil(3 * total / CELLS - 0.1))))
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(seen[cells].astype(np.int64))], names=["cell", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, texts = np.zeros(CELLS, dtype=np.uint16), 0, 0
        for batch in batches:
            for tokens in shingle_sets(batch.column(0), n_words):
                if texts == _COUNTED:
                    yield counted(seen, total)
                    seen[:], total, texts = 0, 0, 0
                np.add.at(seen, (tokens & U(CELLS - 1)).astype(np.int64), 1)
                total, texts = total + len(tokens), texts + 1
        yield counted(seen, total)

    return run


def frequent_cells(texts: DataFrame, n_words: int) -> bytes:
    """A bitmap of CELLS bits (a fixed 1 MB) of the tokens that many texts have.

    It decides only which tokens come last in the orders.  Any choice gives
    the same links; this one keeps shared passages out of the prefixes.
    """
    cells = staged(texts.mapInArrow(_frequencies(n_words), "cell long, seen long").groupBy("cell").agg(F.sum("seen").alias("seen")), "cells")
    least = max(FREQUENT, 8 * (cells.agg(F.sum("seen")).first()[0] or 0) // CELLS)
    bits = np.zeros(CELLS, dtype=bool)
    bits[[r["cell"] for r in cells.where(F.col("seen") >= least).select("cell").toLocalIterator()]] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _prefix(ordered: np.ndarray, last: np.ndarray, percent: int) -> np.ndarray:
    """First tokens of an order in which the marked ones come last."""
    n = len(ordered)
    if not n:
        return ordered
    size = n * (100 - percent) // 100 + 1
    head = ordered[~last][:size]
    return np.concatenate([head, ordered[last][: size - len(head)]]) if len(head) < size else head


def _sets(n_words: int, percent: int, frequent: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.frombuffer(frequent, dtype=np.uint8)
        for batch in batches:
            sizes, one, two, sketches = [], [], [], []
            prefixes: dict[str, list[np.ndarray]] = {"first": [], **{name: [] for name in _ORDERS}}
            for tokens in shingle_sets(batch.column(1), n_words):
                sizes.append(len(tokens))
                odd = np.bincount((tokens >> U(64 - 10)).astype(np.int64), minlength=64 * SKETCH) & 1
                sketches.append(np.packbits(odd.astype(bool)).view(np.int64))
                cell = tokens & U(CELLS - 1)
                last = (late[(cell >> U(3)).astype(np.int64)] >> (cell & U(7)).astype(np.uint8)) & 1 > 0
                mixed = mix(tokens)
                with np.errstate(over="ignore"):
                    one.append(int(np.sum(mixed, dtype=U)))
                    two.append(int(np.bitwise_xor.reduce(mixed * U(0x9E3779B97F4A7C15))) if len(tokens) else 0)
                prefixes["first"].append(_prefix(tokens, last, percent).view(np.int64))
                for name, salt in _ORDERS.items():
                    other = mix(tokens ^ salt)
                    order = np.argsort(other)
                    # Half of a hash is enough here: equal tokens agree in it.
                    prefixes[name].append((_prefix(other[order], last[order], percent) >> U(32)).astype(np.uint32).view(np.int32))
            if not sizes:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(one, dtype=U).view(np.int64)),
                    pa.array(np.array(two, dtype=U).view(np.int64)),
                    *(_lists(x) for x in prefixes.values()),
                    *(pa.array(x) for x in np.stack(sketches, axis=1)),
                ],
                names=["id", "n", "c1", "c2", *prefixes, *_BITS],
            )

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def _verified(n_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(shingle_sets(batch.column("tx"), n_words), shingle_sets(batch.column("ty"), n_words), strict=True):
                both = len(np.intersect1d(left, right, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(keep), batch.column("y").filter(keep)], names=["x", "y"])

    return run


def _close(a: str, b: str, percent: int) -> F.Column:
    """The sizes of two sets allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _ahead(na: str, nb: str, at_a: str, at_b: str, percent: int) -> F.Column:
    """A token and what stands behind it in both sets allow the similarity."""
    most = F.least(F.col(na) - F.col(at_a), F.col(nb) - F.col(at_b))
    return most * (100 + percent) >= (F.col(na) + F.col(nb)) * percent


def _alike(na: str, nb: str, a: str, b: str, percent: int) -> F.Column:
    """The sketches of two sets allow the similarity."""
    apart = sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in _BITS[1:]), F.bit_count(F.col(f"{a}b0").bitwiseXOR(F.col(f"{b}b0"))))
    return apart * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)


def _met(left: DataFrame, right: DataFrame, key: str, apart: str, percent: int, sketched: bool = False) -> DataFrame:
    """Pairs x < y of postings (key, id, n, at) that meet under a key and may reach the similarity."""
    side = lambda rows, p: rows.select(key, *(F.col(c).alias(f"{p}_{c}") for c in rows.columns if c != key))
    pairs = side(left, "l").join(side(right, "r"), key).where(apart).where(_close("l_n", "r_n", percent)).where(_ahead("l_n", "r_n", "l_at", "r_at", percent))
    pairs = pairs.where(_alike("l_n", "r_n", "l_", "r_", percent)) if sketched else pairs
    return pairs.select(F.least("l_id", "r_id").alias("x"), F.greatest("l_id", "r_id").alias("y"))


def _spanning(rows: DataFrame, key: str) -> DataFrame:
    """Postings of the lists that span components, with the list's largest component and how many members are outside it."""
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("c")).groupBy(key).agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("top"))
    return rows.join(sizes.select(key, F.col("top.component").alias("main"), (F.col("m") - F.col("top.c")).alias("outside")).where("outside > 0"), key)


def _across(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs across components; every one has a member outside the largest component."""
    own = lambda rows: rows.select(key, "id", "n", "at", "component", *_BITS)
    pairs = _met(own(rows.where("component <> main")), own(rows), key, "l_component <> r_component", percent, sketched=True)
    return pairs.distinct()


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Components of texts whose shingle sets have Jaccard similarity of percent / 100 or more.

    Returns (members, links).  members has id, n (set size), representative
    (smallest id with the same set) and component (smallest id reachable by
    links), one row for each input row.  links has x < y, verified pairs of
    representatives.

    A null or wordless text has n = 0 and is linked with nothing.  A text of
    fewer than n_words words has its whole word sequence as one shingle.  A
    null id gives a row with null representative and component.  Rows that
    repeat an id are one node.  Other columns of the input are ignored.
    """
    source = own_columns(docs, id=id_col, text=text_col)
    frequent = frequent_cells(source.select("text"), n_words)
    sets = staged(source.mapInArrow(_sets(n_words, percent, frequent), _SETS), "sets")
    named = sets.where("id is not null and n > 0")
    classes = staged(named.groupBy("c1", "c2", "n").agg(F.min("id").alias("representative")), "classes")
    nodes = classes.select(F.col("representative").alias("id")).distinct()
    lists = named.join(nodes, "id", "left_semi")

    # Posting lists of the first order with two members or more.
    tokens = lists.select("id", "n", F.posexplode("first").alias("at", "token"))
    heads = staged(tokens.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("m")).where("low <> high").select("token", "m"), "heads")
    posted = staged(tokens.join(heads, "token").select("token", "id", "n", "at", "m"), "posted")
    second = staged(lists.join(posted.select("id").distinct(), "id", "left_semi").select("id", "n", *_ORDERS, *_BITS), "second")
    narrow = staged(sets.select("id", "n", "c1", "c2"), "narrow")
    discard(heads, sets)

    def under(prefix: str, name: str) -> DataFrame:
        return second.select(F.col("id").alias(name), F.col("n").alias(f"{prefix}n"), *(F.col(b).alias(f"{prefix}{b}") for b in _BITS))

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs x, y that share prefix tokens under all other orders and reach the similarity."""
        alike = pairs.join(under("l_", "x"), "x").join(under("r_", "y"), "y").where(_alike("l_n", "r_n", "l_", "r_", percent))
        alike = staged(alike.select("x", "y"), "alike")
        prefixes = lambda name, s: second.select(F.col("id").alias(name), *(F.col(o).alias(f"{s}{o}") for o in _ORDERS))
        shared = alike.join(prefixes("x", "l_"), "x").join(prefixes("y", "r_"), "y")
        for order in _ORDERS:
            shared = shared.where(F.arrays_overlap(f"l_{order}", f"r_{order}"))
        candidates = staged(shared.select("x", "y"), "candidates")
        ids = staged(candidates.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "ids")
        texts = only(source, ids, "id")
        verified = candidates.join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y")
        links = staged(verified.mapInArrow(_verified(n_words, percent), "x long, y long").distinct(), "links")
        discard(alike, candidates, ids)
        return links

    short, long = (posted.where(f"m {sign} {SHORT_LIST}").drop("m") for sign in ("<=", ">"))
    hub = lambda k: F.min(F.struct((F.xxhash64("id", F.lit(k)) if k else F.col("id")).alias("h"), F.struct("id", "n", "at").alias("p")))["p"]
    hubs = long.groupBy("token").agg(F.array_distinct(F.array(*(hub(k) for k in range(STARS)))).alias("hubs")).select("token", F.explode("hubs").alias("p")).select("token", "p.*")
    pairs = _met(short, short, "token", "l_id < r_id", percent).union(_met(hubs, long, "token", "l_id <> r_id", percent))
    pairs = staged(pairs.distinct(), "pairs")
    links = verify(pairs)
    found = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))

    # Long lists that still span components: pairs across components.
    rest = long.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sketches = second.select("id", *_BITS)
    rest = staged(_spanning(rest, "token").join(sketches, "id"), "rest").withColumnRenamed("token", "key")
    more = _across(rest.where(f"outside <= {LONG_LIST}"), "key", percent)
    for order in _ORDERS:
        wide = rest.where(f"outside > {LONG_LIST}")
        if wide.isEmpty():
            break
        fine = wide.select("key", "id", "n", "at", "component").join(second.select("id", F.explode(order).alias("other")), "id")
        fine = fine.select(F.xxhash64("key", "other").alias("key"), "id", "n", "at", "component").distinct()
        rest = staged(_spanning(fine, "key").join(sketches, "id"), "rest")
        last = order == list(_ORDERS)[-1]
        more = more.union(_across(rest if last else rest.where(f"outside <= {LONG_LIST}"), "key", percent))
    more = staged(more.distinct().join(pairs, ["x", "y"], "left_anti"), "across")
    if not more.isEmpty():
        links = links.union(verify(more))
        found = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
    discard(posted, second, pairs, more)

    classes = classes.join(found.select(F.col("node").alias("representative"), "component"), "representative", "left").withColumn("component", F.coalesce("component", "representative"))
    members = narrow.join(classes, ["c1", "c2", "n"], "left").select(
        "id",
        "n",
        F.when(F.col("id").isNotNull(), F.coalesce("representative", "id")).alias("representative"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"),
    )
    return members, links
