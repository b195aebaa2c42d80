"""Sequence analytics, top-k rules and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_words


def turn_index(series: DataFrame, run: int = 3) -> DataFrame:
    """Where a series (series, at, value) turns: the first of so many steps in a row that all go one
    way and are all larger than the median step.  series, at (where that step arrives), n (its
    place, from 1), value, step, usual.  Shorter series than run + 2 do not turn.
    """
    w = Window.partitionBy("series").orderBy("at")
    steps = series.withColumn("step", F.col("value") - F.lag("value").over(w)).withColumn("n", F.row_number().over(w))
    usual = steps.groupBy("series").agg(F.percentile(F.abs("step"), F.lit(0.5)).alias("usual"), F.count("*").alias("length")).where(F.col("length") >= run + 2)
    ahead = w.rowsBetween(0, run - 1)
    moves = steps.withColumn("low", F.min("step").over(ahead)).withColumn("high", F.max("step").over(ahead)).withColumn("m", F.count("step").over(ahead)).join(usual, "series")
    turned = moves.where((F.col("n") > 1) & (F.col("m") == run) & ((F.col("low") > F.col("usual")) | (-F.col("high") > F.col("usual"))))
    first = turned.groupBy("series").agg(F.min_by(F.struct("at", "n", "value", "step", "usual"), "n").alias("x"))
    return first.select("series", "x.at", "x.n", F.round("x.value", 6).alias("value"), F.round("x.step", 6).alias("step"), F.round("x.usual", 6).alias("usual"))


def series_breaks(cells: DataFrame, dates: DataFrame, seeds: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Series that turn in a matter's own week, and the numbers that they leave behind.

    cells: series, doc, column, at (day), value.  dates: seed, date.  seeds: seed, doc.  A series
    turns where the first of its columns does.  Returns (seed, series, doc, period) without the
    seed's own documents, and (seed, series, number, n, total) of the values before it in the columns that
    turn there: how often each occurs, and their sum.
    """
    columns = cells.select(F.struct("series", "doc", "column").alias("series"), "at", "value")
    turns = turn_index(columns).select("series.series", "series.doc", "series.column", "at", "n")
    first = turns.groupBy("series", "doc").agg(F.min("n").alias("n"))
    turns = turns.join(first, ["series", "doc", "n"])
    # A matter's week is at most days + 1 days, so days and series meet by equality.
    week = dates.select("seed", F.explode(F.sequence("date", F.date_add("date", days))).alias("at"))
    met = turns.join(week, "at").join(seeds, ["seed", "doc"], "left_anti")
    before = met.select("seed", "series", "doc", "column", F.col("at").alias("period")).join(cells, ["series", "doc", "column"]).where("at < period").groupBy("seed", "series", F.col("value").alias("number")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return met.groupBy("seed", "series", "doc").agg(F.min("at").alias("period")), before


def pieces_halved(sections: DataFrame) -> DataFrame:
    """The boundary that cuts each document's sections (doc, line, text) into the two runs nearest
    in length, sections joined by one newline; the first of equals.  doc, cut (the second run's first line).
    """
    w = Window.partitionBy("doc").orderBy("line")
    own = sections.select("doc", "line", (F.length("text") + 1).alias("n")).withColumn("before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("whole", F.sum("n").over(Window.partitionBy("doc")))
    return own.where("before is not null").groupBy("doc").agg(F.min_by("line", F.struct(F.abs(F.col("whole") - 2 * F.col("before")), "line")).alias("cut"))


def in_reply_order(ids: DataFrame, reply: DataFrame) -> DataFrame:
    """Ids (room, id, place) in the order of their room's reply (room, id, at): its first mentions, then what it left out; unknown ids drop out.  room, id, rank."""
    said = reply.groupBy("room", "id").agg(F.min("at").alias("at"))
    order = Window.partitionBy("room").orderBy(F.col("at").isNull(), "at", "place")
    return ids.join(said, ["room", "id"], "left").select("room", "id", F.row_number().over(order).alias("rank"))


def within_budget(sizes: DataFrame, budget: int) -> DataFrame:
    """Consecutive rows (room, place, size) of each room in groups within a budget, greedily; a larger row is alone.  room, place, group.

    Rooms are dealt over tasks and their rows come in order, so that a task holds a total and a
    number, and a room of any length streams through.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, group, total = object(), 0, 0
        for batch in batches:
            groups = []
            for own, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != room:
                    room, group, total = own, 1, size
                elif total + size <= budget:
                    total += size
                else:
                    group, total = group + 1, size
                groups.append(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(groups, pa.int64())], names=["room", "place", "group"])

    own = sizes.select("room", "place", F.col("size").cast("long").alias("size"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.repartition("room").sortWithinPartitions("room", "place").mapInArrow(dealt, f"room {kinds['room']}, place {kinds['place']}, `group` long")


def agreement(hits: DataFrame) -> DataFrame:
    """Share of facts (row, fact, pass, hit) that both passes of a row hit, and the row's recall: row, agreed, recall."""
    per = hits.groupBy("row", "fact").agg(F.min(F.col("hit").cast("int")).alias("both"), F.avg(F.col("hit").cast("int")).alias("any"))
    return per.groupBy("row").agg(F.round(F.avg("both"), 6).alias("agreed"), F.round(F.avg("any"), 6).alias("recall"))


def cheapest_passing(rows: DataFrame) -> DataFrame:
    """The row (model, dollars, clean, full) with the lowest price of those that pass: model, dollars."""
    return rows.where("clean and full").agg(F.min(F.struct("dollars", "model")).alias("x")).where("x is not null").select("x.model", "x.dollars")


def ask_scores(scores: DataFrame) -> DataFrame:
    """Mean over asks of the greatest score of any piece and question (doc, ask, score): doc, score."""
    return scores.groupBy("doc", "ask").agg(F.max("score").alias("score")).groupBy("doc").agg(F.round(F.avg("score"), 6).alias("score"))


#: Rows of a side that is sent to all tasks, at most.
SMALL_SIDE = 200_000


def if_small(side: DataFrame) -> DataFrame:
    """A side to be broadcast if its rows, counted, are few; else as it is."""
    return F.broadcast(side) if side.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE else side


def choose(ranked: DataFrame, budget: int, group: list[str]) -> DataFrame:
    """The longest prefix of each group's ranking (rank, cost) within a budget; the first always."""
    total = F.sum("cost").over(Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("total", total).where((F.col("total") <= budget) | (F.col("rank") == 1))


def round_robin(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """Up to `most` rows, taken in turns from each group in its order: turn, place."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    # Turns up to `most` can be in the result, so each group sends few rows to the final ranking.
    few = rows.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", by).limit(most)
    return few.withColumn("place", F.row_number().over(Window.orderBy("turn", by)))


def closest_section(sections: DataFrame, asks: DataFrame) -> DataFrame:
    """The section that shares most content words with each ask, earliest anchor first: ask, anchor, shared.

    sections: anchor, text.  asks: ask, text, and if given without (words that do not count).  Words are joined with words, so
    no text meets every section; few asks go to the sections' words, which are
    then counted where they are before anything is shuffled.
    """
    held = sections.select("anchor", F.explode(content_words(F.col("text"))).alias("w"))
    words = content_words(F.col("text"))
    wanted = asks.select("ask", F.explode(F.array_except(words, "without") if "without" in asks.columns else words).alias("w"))
    shared = held.join(if_small(wanted), "w").groupBy("ask", "anchor").agg(F.count("*").alias("shared"))
    best = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("shared"), "anchor"))
    return shared.withColumn("r", best).where("r = 1").select("ask", "anchor", "shared")


def largest_per_doc(figures: DataFrame) -> DataFrame:
    """doc, value, anchor of each document's largest figure, earliest anchor first."""
    return figures.groupBy("doc").agg(F.max("value").alias("value"), F.min_by("anchor", F.struct(-F.col("value"), "anchor")).alias("anchor"))


def stated_against_done(stated: DataFrame, done: DataFrame) -> DataFrame:
    """Deadlines (key, days, day) held against acts (key, day): the first act, and how late it was."""
    acts = done.groupBy("key").agg(F.min("day").alias("done_day"))
    late = F.datediff("done_day", "day") - F.col("days")
    return stated.join(acts, "key").select("key", "days", "day", "done_day", late.alias("late")).where("late > 0")


def rarest(values: DataFrame, most: int = 40) -> DataFrame:
    """The values with the fewest documents, ties by value: value, n."""
    return values.groupBy("value").agg(F.countDistinct("doc").alias("n")).orderBy("n", "value").limit(most)


def running_balance(spend: DataFrame, start: float, group: str) -> DataFrame:
    """Rows (group, at, id, amount) with what is left of `start` after each."""
    w = Window.partitionBy(group).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return spend.withColumn("balance", F.round(F.lit(start) - F.sum("amount").over(w), 6))


def shared_runs(left: DataFrame, right: DataFrame, runs: F.Column) -> DataFrame:
    """For each left row (a, text) that shares a run of content words with right rows (b, text):
    the first b, and how many runs they share.  Runs are joined with runs.
    """
    own = left.select("a", F.explode(runs).alias("run"))
    other = right.select("b", F.explode(runs).alias("run"))
    both = other.join(if_small(own), "run").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return both.groupBy("a").agg(F.min(F.struct("b", "shared")).alias("first")).select("a", "first.b", "first.shared")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("r", rank).where("r = 1").drop("r")


def top_per_group(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first rows of each group in an order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)
