"""Checks around notes: quotes located, values they are about, items merged, sections cut to size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.carry import amount_surfaces, straighten, units
from tessera.functions.words import fold
from tessera.operators.sections import packed_pieces

#: Parts a document's sections are joined by where quotes are looked for.
_GAP = "\u0000"
# Kinds of references.
KINDS = ("code", "document", "name", "person", "regulator", "ticket")


def located_in(quotes: DataFrame, sections: DataFrame) -> DataFrame:
    """Where quotes (doc, seq, quote) begin in their document's sections (doc, ordinal, anchor, text): doc, seq, anchor.

    Both are straightened.  Sections come first, in order, then neighbours joined by one space.
    Quotes that are nowhere, or empty, have no row.  A document's sections are one row here.
    """
    own = sections.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ordinal", "anchor", straighten(F.col("text")).alias("t")))).alias("own"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("own") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at("own", i)["t"], F.get("own", i)["t"]))
    whole = own.select("doc", "own", F.array_join(F.col("own.t"), _GAP).alias("alone"), F.array_join(pairs, _GAP).alias("paired"))
    asked = quotes.select("doc", "seq", straighten(F.col("quote")).alias("needle")).where("needle <> ''").join(whole, "doc")
    place = lambda text: F.when(F.expr(f"instr({text}, needle)") > 0, F.size(F.split(F.substring(text, F.lit(1), F.expr(f"instr({text}, needle)") - 1), _GAP)))
    found = asked.withColumn("at", F.coalesce(place("alone"), place("paired"))).where("at is not null")
    return found.select("doc", "seq", F.element_at("own", F.col("at"))["anchor"].alias("anchor"))


def verified_about(about: Column, quote: Column) -> Column:
    """The different values of a flag that stand in its quote, in order."""
    return F.array_distinct(F.filter(F.coalesce(about, F.array().cast("array<string>")), lambda v: v.isNotNull() & straighten(quote).contains(straighten(v))))


def about_values(about: Column, quote: Column, named: Column) -> Column:
    """These, then the document's own named values that stand in the quote, each once."""
    kept = verified_about(about, quote)
    have = F.transform(kept, lambda v: straighten(v))
    more = F.filter(F.array_distinct(named), lambda v: (straighten(v) != "") & straighten(quote).contains(straighten(v)) & ~F.array_contains(have, straighten(v)))
    return F.concat(kept, more)


def uncovered(named: DataFrame, flags: DataFrame) -> DataFrame:
    """Named values (doc, seq, value) that stand in no flag's quote (doc, quote), folded, each form once: doc, seq, value."""
    quotes = flags.groupBy("doc").agg(F.collect_set(fold(F.col("quote"))).alias("quotes"))
    own = named.withColumn("folded", fold(F.col("value"))).where("folded <> ''").groupBy("doc", "folded").agg(F.min(F.struct("seq", "value")).alias("x"))
    out = own.join(quotes, "doc", "left").where(~F.coalesce(F.exists("quotes", lambda q: q.contains(F.col("folded"))), F.lit(False)))
    return out.select("doc", "x.seq", "x.value")


def checked_items(items: DataFrame, sections: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items (doc, seq, quote and other keys) that are whole and whose quote is found, with its anchor; repeats on all keys go.

    Returns (items with anchor, dropped: doc, seq, reason).  A figure's surface must stand in its quote,
    a reference's kind must be known.
    """
    reason = F.coalesce(*(F.when(F.col(k).isNull(), F.lit(f"missing key {k}")) for k in keys))
    found = items.join(located_in(items, sections).withColumnRenamed("anchor", "place"), ["doc", "seq"], "left")
    reason = F.coalesce(reason, F.when(F.col("place").isNull(), F.lit("quote not found verbatim")))
    if "surface" in keys:
        reason = F.coalesce(reason, F.when(~straighten(F.col("quote")).contains(straighten(F.col("surface"))), F.lit("surface not inside the quote")))
    if "kind" in keys:
        reason = F.coalesce(reason, F.when(~F.col("kind").isin(*KINDS), F.lit("unknown kind")))
    judged = found.withColumn("reason", reason)
    first = F.row_number().over(Window.partitionBy("doc", *keys).orderBy("seq"))
    kept = judged.where("reason is null").withColumn("r", first).where("r = 1").drop("r", "reason", "anchor").withColumnRenamed("place", "anchor")
    return kept, judged.where("reason is not null").select("doc", "seq", "reason")


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Items of two attempts (doc, seq and other columns): the first's, then what only the second has, renumbered."""
    rest = [c for c in first.columns if c not in ("doc", "seq")]
    both = first.withColumn("attempt", F.lit(1)).unionByName(second.withColumn("attempt", F.lit(2)))
    kept = both.withColumn("signature", F.to_json(F.struct(*sorted(rest)))).groupBy("doc", "signature").agg(F.min(F.struct("attempt", "seq", *rest)).alias("x"))
    return kept.select("doc", "x.*").withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("attempt", "seq")) - 1).select("doc", "seq", *rest)


def harvested(sections: DataFrame) -> DataFrame:
    """Money amounts and percentages of sections (doc, ordinal, anchor, text), unit by unit: doc, ordinal, at, n, surface, quote, anchor."""
    own = sections.select("doc", "ordinal", "anchor", F.posexplode(units(F.col("text"))).alias("at", "quote"))
    return own.select("doc", "ordinal", "at", F.posexplode(amount_surfaces(F.col("quote"))).alias("n", "surface"), "quote", "anchor")


def cut_sections(sections: DataFrame, limit: int) -> DataFrame:
    """Sections (doc, ordinal, anchor, text) in parts of at most so many characters: doc, ordinal, part, anchor, text.

    A longer section is cut between its lines, and a longer line every `limit` characters.  Parts are
    filled in order.
    """
    pieces = F.flatten(F.transform(F.split("text", "\n"), lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(line) / limit) - 1, F.lit(0))), lambda i: F.substring(line, (i * limit + 1).cast("int"), F.lit(limit)))))
    fold_ = f"""aggregate(pieces, cast(array() as array<string>), (done, s) -> case
        when size(done) > 0 and length(element_at(done, -1)) + 1 + length(s) <= {limit} then concat(slice(done, 1, size(done) - 1), array(concat(element_at(done, -1), '\\n', s)))
        else concat(done, array(s)) end)"""
    parts = F.when(F.length("text") <= limit, F.array("text")).otherwise(F.expr(fold_))
    return sections.withColumn("pieces", pieces).select("doc", "ordinal", "anchor", F.posexplode(parts).alias("part", "text"))


def split_sections(sections: DataFrame, limit: int) -> DataFrame:
    """A document's sections in pieces of at most so many characters, none of them longer: doc, piece, first, last (ordinals), n_sections, chars.

    Longer sections are cut first; the parts of one count as sections.
    """
    place = F.col("ordinal").cast("long") * 1_000_000 + F.col("part")
    packed = packed_pieces(cut_sections(sections, limit).withColumn("place", place), limit, "place")
    ordinal = lambda c: F.floor(F.col(c) / 1_000_000).cast("long").alias(c)
    return packed.select("doc", "piece", ordinal("first"), ordinal("last"), "n_sections", "chars")


def reply_object(text: Column, schema: str) -> Column:
    """A reply as one JSON object, a code fence around it stripped; null if it is none."""
    plain = F.trim(text)
    inner = F.when(plain.startswith("```"), F.regexp_replace(F.regexp_replace(plain, r"^```[^\n]*\n?", ""), r"\s*```\s*$", "")).otherwise(plain)
    return F.when(F.trim(inner).startswith("{"), F.from_json(inner, schema))


def well_shaped(reply: Column) -> Column:
    """A reply says what the document is, and has one of the four lists."""
    return F.coalesce((F.trim(reply["what"]) != "") & (reply["flags"].isNotNull() | reply["figures"].isNotNull() | reply["cross_references"].isNotNull() | reply["concealed"].isNotNull()), F.lit(False))


def counts(notes: DataFrame, log: DataFrame, documents: DataFrame) -> DataFrame:
    """How many documents, notes (doc), dropped items and re-asked ones (doc, outcome) there are: one row."""
    logged = log.agg(F.count_if(F.col("outcome") == "dropped").alias("dropped"), F.count_if(F.col("outcome") == "re-asked").alias("asked_again"))
    return documents.agg(F.countDistinct("doc").alias("documents")).crossJoin(notes.agg(F.countDistinct("doc").alias("noted"))).crossJoin(logged)
