"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Vectors are lifted so that the largest inner product is the largest cosine
(one more component evens out the norms) and stored in 8 bits each for the
graph; results are ranked on the original vectors in double precision.

* Start: random hyperplanes cut the vectors into small cells; within a cell
  all pairs are compared.
* Descent: a node's list and the lists it is in are joined; all its
  neighbours are compared with each other, and each keeps the best it is
  shown.  That is two joins and two groupings per round, on bounded lists.
* Search: a query's best unexpanded nodes are joined with their lists, what
  beats the query's worst kept candidate is merged in, and so on.

Vectors that are alike are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._tables import own_columns, staged

#: Neighbours in a node's list, and most lists it is in that a round looks at.
LIST, REVERSE = 48, 48
#: Descent ends when a round lifts the lists' mean score by less than this share of it, and after so many rounds at most.
SETTLED, ROUNDS = 0.002, 8
#: Candidates that a query keeps, and how many of them it expands in each search round; the last number goes on.
BEAM, EXPAND = 256, (1, 24, 48, 64)
#: The search ends when all but a hundredth of the queries have expanded their best so many, and after so many rounds at most.
NEAR, SEARCHES = 96, 7
#: Nodes of a starting cell, and how many times the space is cut.
CELL, TREES = 160, 3
#: Copies of a vector that can be in a result.
_COPIES = 24
_SCALE = 1_000_000


def _packed(vectors: np.ndarray) -> list[bytes]:
    """8-bit components and one 32-bit scale per vector."""
    top = np.maximum(np.abs(vectors).max(axis=1, initial=0), 1e-30)
    small = np.round(vectors / top[:, None] * 127).astype(np.int8)
    return [s.astype("<f4").tobytes() + v.tobytes() for s, v in zip(top / 127, small, strict=True)]


def _unpacked(packed: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
    scale = rows[:, :4].copy().view("<f4")
    return rows[:, 4:].view(np.int8).astype(np.float32) * scale


def _lifted(largest: float, width: int, cells: int):
    """node, packed vector, packed query, and the cell in each tree."""
    bits = max(0, int(np.ceil(np.log2(max(cells, 1)))))
    planes = np.random.default_rng(11).standard_normal((TREES, width + 1, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, width + 1))
            for k, v in enumerate(batch.column("vector").to_pylist()):
                x[k, : len(v)] = v
            x /= largest
            norm = (x**2).sum(axis=1)
            query = x / np.sqrt(norm)[:, None]
            x[:, -1] = np.sqrt(np.maximum(1 - norm, 0))
            keys = [((x @ planes[t]) > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), dtype=np.int64) for t in range(TREES)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(_packed(x), pa.binary()), pa.array(_packed(query), pa.binary()), pa.array(np.stack(keys, axis=1).astype(np.int64).tolist(), pa.list_(pa.int64()))],
                names=["node", "vec", "query", "cells"],
            )

    return run


def _out(u: list, v: list, s: list) -> pa.RecordBatch:
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(join(u).astype(np.int64)), pa.array(join(v).astype(np.int64)), pa.array(join(s).astype(np.int32))], names=["u", "v", "s"])


def _compared(best: int, bounded: bool):
    """All pairs of a row's members; each member keeps its best ones (above its bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, ss = [], [], []
            for members in batch.column("members"):
                nodes = members.values.field("node").to_numpy()
                if len(nodes) < 2:
                    continue
                x = _unpacked(members.values.field("vec").to_pylist())
                scores = x @ x.T
                np.fill_diagonal(scores, -9)
                if bounded:
                    scores[scores * _SCALE <= members.values.field("bound").to_numpy()[:, None]] = -9
                keep = min(best, len(nodes) - 1)
                top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                value = np.take_along_axis(scores, top, axis=1)
                good = value > -5
                us.append(np.broadcast_to(nodes[:, None], top.shape)[good])
                vs.append(nodes[top][good])
                ss.append(np.round(value[good] * _SCALE))
            yield _out(us, vs, ss)

    return run


def _visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of a node's neighbours for the queries that expand it, above each query's bound."""
    for batch in batches:
        us, vs, ss = [], [], []
        for nodes, packed, asks in zip(batch.column("nodes"), batch.column("packed"), batch.column("asks"), strict=True):
            nodes = nodes.values.to_numpy()
            x = _unpacked(packed.values.to_pylist())
            q = _unpacked(asks.values.field("query").to_pylist())
            scores = np.round(q @ x.T * _SCALE)
            good = scores > asks.values.field("bound").to_numpy()[:, None]
            row, column = np.nonzero(good)
            us.append(asks.values.field("q").to_numpy()[row])
            vs.append(nodes[column])
            ss.append(scores[good])
        yield _out(us, vs, ss)


def _lists(edges: DataFrame, size: int) -> DataFrame:
    """u, list: its best neighbours, best first.

    Each task cuts its own rows of a node before they are shuffled, so that a
    node in very many lists is never gathered whole.
    """
    rank = F.dense_rank().over(Window.partitionBy("u").orderBy(F.desc("s"), F.desc("v")))
    few = edges.select("u", "v", "s").withColumn("r", rank).where(F.col("r") <= size)
    return few.groupBy("u").agg(F.sort_array(F.collect_set(F.struct("s", "v")), False).alias("list"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row its k nearest other rows of `vectors` by inner product.

    queries: a table with the same columns, of rows that are in `vectors`.
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    Vectors that are null, empty, zero, or hold a null or a component that is
    not finite take no part, as query or candidate, nor do null ids.  Shorter
    vectors are filled up with zeros.  Rows that repeat an id count once.
    Fewer candidates than k give fewer rows.  Other columns are ignored.
    """
    usable = F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)")
    doubles = lambda df: own_columns(df, id=id_col, vector=vector_col).select("id", F.col("vector").cast("array<double>").alias("vector")).where("id is not null").where(usable)
    rows = doubles(vectors).dropDuplicates(["id"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    # Copies: few of each kind, gathered in two steps so that none grows large.
    few = lambda c: F.slice(F.sort_array(c), 1, _COPIES + k)
    copies = rows.groupBy("vector", "salt").agg(few(F.collect_list("id")).alias("ids")).groupBy("vector").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    copies = staged(copies.select(F.col("ids")[0].alias("node"), "ids", "vector"), "copies")
    facts = copies.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(F.expr("aggregate(vector, 0d, (a, x) -> a + x * x)")).alias("norm")).first()
    n = facts["n"]
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lifted = staged(copies.select("node", "vector").mapInArrow(_lifted(float(np.sqrt(facts["norm"])), facts["width"], n // CELL), "node long, vec binary, query binary, cells array<long>"), "lifted")

    # Cells, the large ones dealt into parts of bounded size.
    cells = lifted.select("node", F.posexplode("cells").alias("tree", "cell"))
    counts = cells.groupBy("tree", "cell").agg(F.count("*").alias("m"))
    cells = cells.join(counts, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / (2 * CELL))))
    groups = cells.join(lifted.select("node", "vec"), "node").groupBy("tree", "cell", "part").agg(F.collect_list(F.struct("node", "vec")).alias("members"))
    lists = staged(_lists(groups.select("members").mapInArrow(_compared(LIST // 2, False), "u long, v long, s int"), LIST), "lists")

    def around(lists: DataFrame) -> DataFrame:
        """u, v for the neighbours in u's list and the best of those in whose list u is."""
        forward = lists.select("u", F.explode("list").alias("e")).select("u", "e.s", "e.v")
        back = _lists(forward.select(F.col("v").alias("u"), "s", F.col("u").alias("v")), REVERSE)
        return forward.select("u", "v").union(back.select("u", F.explode("list.v").alias("v"))).distinct()

    # Up to two cells' nodes the cells have compared nearly all pairs, and their lists are as good as any round makes them.
    reached = None
    for _ in range(ROUNDS if n > 2 * CELL else 0):
        bounds = lists.select(F.col("u").alias("v"), F.when(F.size("list") >= LIST, F.element_at("list", -1)["s"]).otherwise(F.lit(-9 * _SCALE)).alias("bound"))
        shown = around(lists).join(lifted.select(F.col("node").alias("v"), "vec"), "v").join(bounds, "v", "left")
        shown = shown.groupBy("u").agg(F.collect_list(F.struct(F.col("v").alias("node"), "vec", F.coalesce("bound", F.lit(-9 * _SCALE)).alias("bound"))).alias("members"))
        better = shown.select("members").mapInArrow(_compared(4, True), "u long, v long, s int")
        lists = staged(_lists(better.union(lists.select("u", F.explode("list").alias("e")).select("u", "e.v", "e.s")), LIST), "lists")
        mean = lists.agg(F.avg(F.expr("aggregate(list, 0d, (a, e) -> a + e.s) / size(list)"))).first()[0]
        if reached is not None and mean - reached < SETTLED * abs(mean):
            break
        reached = mean

    table = around(lists).join(lifted.select(F.col("node").alias("v"), "vec"), "v").groupBy("u").agg(F.collect_list("v").alias("nodes"), F.collect_list("vec").alias("packed"))
    table = staged(table.select(F.col("u").alias("at"), "nodes", "packed"), "table")

    asked = doubles(queries).select(F.col("id").alias("query_id")).distinct()
    asked = staged(asked.join(copies.select(F.col("node").alias("q"), F.explode("ids").alias("query_id")), "query_id").union(
        # a query beyond its kind's first few copies is found by its vector
        doubles(queries).dropDuplicates(["id"]).join(copies.where(F.size("ids") >= _COPIES + k).select(F.col("node").alias("q"), "vector"), "vector").select(F.col("id").alias("query_id"), "q")
    ).distinct(), "asked")
    nodes = asked.select("q").distinct().join(lifted.select(F.col("node").alias("q"), "query"), "q")
    beam = staged(nodes.select("q", "query", F.array(F.struct(F.lit(9 * _SCALE).alias("s"), F.col("q").alias("v"), F.lit(False).alias("done"))).alias("beam")), "beam")
    for search in range(SEARCHES):
        expand = EXPAND[min(search, len(EXPAND) - 1)]
        open_ = F.exists(F.slice("beam", 1, NEAR), lambda b: ~b["done"])
        left = beam.agg(F.count_if(open_).alias("open"), F.count("*").alias("n")).first()
        if left["open"] * 100 <= left["n"]:
            break
        chosen = F.slice(F.filter("beam", lambda b: ~b["done"]), 1, expand)
        bound = F.when(F.size("beam") >= BEAM, F.element_at("beam", -1)["s"]).otherwise(F.lit(-9 * _SCALE))
        asks = beam.select("q", "query", bound.alias("bound"), F.explode(chosen).alias("b")).select(F.col("b.v").alias("at"), F.pmod("q", F.lit(16)).alias("salt"), F.struct("q", "query", "bound").alias("ask"))
        asks = asks.groupBy("at", "salt").agg(F.collect_list("ask").alias("asks")).join(table, "at")
        found = asks.select("nodes", "packed", "asks").mapInArrow(_visited, "u long, v long, s int").select(F.col("u").alias("q"), "v", "s", F.lit(False).alias("done"))
        old = beam.select("q", F.explode(F.expr(f"transform(beam, b -> struct(b.s, b.v, b.done or array_contains(transform(slice(filter(beam, c -> not c.done), 1, {expand}), c -> c.v), b.v) as done))")).alias("b")).select("q", "b.v", "b.s", "b.done")
        merged = old.union(found).groupBy("q", "v").agg(F.max("s").alias("s"), F.max("done").alias("done"))
        merged = merged.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "v", "done")), False), 1, BEAM).alias("beam"))
        beam = staged(merged.join(nodes, "q").select("q", "query", "beam"), "beam")

    pairs = beam.select("q", F.explode("beam.v").alias("v"))
    pairs = pairs.join(copies.select(F.col("node").alias("q"), F.col("vector").alias("x")), "q").join(copies.select(F.col("node").alias("v"), F.col("vector").alias("y"), "ids"), "v")
    dot = F.expr("aggregate(zip_with(x, y, (a, b) -> coalesce(a, 0d) * coalesce(b, 0d)), 0d, (a, p) -> a + p)")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    scored = pairs.select("q", dot.alias("score"), F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asked.join(scored, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
