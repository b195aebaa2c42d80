"""Strings looked up in long texts, without reading a text once for each string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.links import written

#: Characters of a word by which strings are looked up, and of the pieces that texts are cut into at least.
GRAM, PIECE = 8, 1024


def _neighbours(words: Column) -> Column:
    """The words beside each single space: x, y."""
    pairs = F.arrays_zip(words.alias("x"), F.slice(words, 2, F.size(words)).alias("y"))
    return F.filter(pairs, lambda p: p["y"].isNotNull())


def _runs(words: DataFrame, lengths: list[int]) -> DataFrame:
    """All runs of so many characters of words (room, w): room, w, key."""
    at = words.select("room", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"))
    runs = F.array(*(F.when(F.col("k") + (n - 1) <= F.length("w"), F.substr("w", "k", F.lit(n))) for n in lengths))
    return at.select("room", "w", F.explode(runs).alias("key")).where("key is not null")


def _pieces(texts: DataFrame, longest: int) -> DataFrame:
    """Texts in pieces, each with the next one's characters, so that no string of up to `longest` is cut in all: room, part, piece."""
    cut = texts.where("text is not null").select("room", F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{max(longest, PIECE)}}}"), 0).alias("c"))
    own = cut.select("room", F.posexplode(F.zip_with("c", F.slice("c", 2, F.size("c")), lambda a, b: F.concat(a, F.coalesce(F.left(b, F.lit(longest)), F.lit(""))))).alias("part", "piece"))
    # A number of partitions of its own, as little text makes much work.
    return written(own.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "room", "part"), "pieces")


def held(sought: DataFrame, texts: DataFrame) -> DataFrame:
    """Which strings (room, quote) a text of their room (room, text) holds anywhere: room, quote, each once.

    A string is looked up by the ends of two words of it that meet at a space, or by its beginning if it is
    one word.  Texts are cut into pieces, and only pieces with these characters are searched for the whole
    string, so that the work grows with the texts and the strings, not with their product.
    """
    gap = F.array_max(F.transform(_neighbours(F.split("quote", " ")), lambda p: F.struct(
        (F.least(F.length(p["x"]), F.lit(GRAM)) + F.least(F.length(p["y"]), F.lit(GRAM))).alias("n"),
        F.least(F.length(p["x"]), F.lit(GRAM)).alias("i"), F.least(F.length(p["y"]), F.lit(GRAM)).alias("j"),
        F.concat(F.right(p["x"], F.lit(GRAM)), F.lit(" "), F.left(p["y"], F.lit(GRAM))).alias("key"))))
    own = sought.where("room is not null and quote is not null").select("room", "quote").distinct()
    keyed = own.where("quote <> ''").select("room", "quote", gap.alias("gap")).select("room", "quote", F.coalesce("gap.i", F.least(F.length("quote"), F.lit(GRAM))).alias("i"), F.col("gap.j").alias("j"), F.coalesce("gap.key", F.left("quote", F.lit(GRAM))).alias("key"))
    keyed = written(keyed, "sought")
    # At most (GRAM + 1) squared shapes.
    shapes = keyed.agg(F.max(F.length("quote")).alias("longest"), F.collect_set(F.struct("i", F.coalesce("j", F.lit(-1)).alias("j"))).alias("shapes")).first()
    found = own.where("quote = ''").join(texts.where("text is not null").select("room").distinct(), "room", "left_semi").select("room", "quote")
    if shapes["longest"] is None:
        return found
    pieces = _pieces(texts, shapes["longest"])
    spaced, single = [s for s in shapes["shapes"] if s["j"] >= 0], sorted(s["i"] for s in shapes["shapes"] if s["j"] < 0)
    words = F.split("piece", " ")
    if spaced:
        # A word that is too short has no such end.
        p = F.col("p")
        ends = F.array(*(F.when((F.length(p["x"]) >= s["i"]) & (F.length(p["y"]) >= s["j"]), F.concat(F.right(p["x"], F.lit(s["i"])), F.lit(" "), F.left(p["y"], F.lit(s["j"])))) for s in spaced))
        keys = pieces.select("room", "part", F.explode(_neighbours(words)).alias("p")).select("room", "part", F.explode(ends).alias("key"))
        # A string that is its own key needs no search.
        met = written(keys.where("key is not null").distinct().join(keyed.where("j is not null"), ["room", "key"]).select("room", "part", "quote", (F.col("quote") == F.col("key")).alias("whole")), "met")
        found = found.unionByName(met.where("whole").select("room", "quote"))
        found = found.unionByName(met.where("not whole").join(pieces, ["room", "part"]).where(F.contains("piece", "quote")).select("room", "quote"))
    if single:
        each = written(pieces.select("room", F.explode(words).alias("w")).where("w <> ''").distinct(), "words")
        keys = _runs(each, single).select("room", "key").distinct()
        found = found.unionByName(keys.join(keyed.where(f"j is null and length(quote) <= {GRAM}"), ["room", "key"]).select("room", "quote"))
        if GRAM in single:
            met = _runs(each, [GRAM]).join(keyed.where(f"j is null and length(quote) > {GRAM}"), ["room", "key"])
            found = found.unionByName(met.where(F.contains("w", "quote")).select("room", "quote"))
    return found.distinct()
