"""Checks of reports against the room: sentences and their citations, numbers, calculations.

Reports are doc, line, text.  Sections are anchor, text, cells (refs of a sheet's row; null else).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import anchors as A
from tessera.functions import carry
from tessera.functions import rows as R
from tessera.functions.sentences import sentences
from tessera.operators.report import NO_SENTENCE, body_lines, narrative


def cited_sentences(reports: DataFrame) -> DataFrame:
    """Sentences of written sections with the citations that cover them: doc, line, section, at (from 1), text, cites.

    A sentence's own citations, wherever they stand in it; without any, those at the end of its line.
    """
    lines = body_lines(narrative(reports)).withColumn("end", R.trailing_citations(F.col("text")))
    parts = lines.select("doc", "line", "section", "end", F.posexplode(sentences(F.col("text"))).alias("at", "said"))
    own = R.citations(F.col("said"))
    return parts.select("doc", "line", "section", (F.col("at") + 1).alias("at"), F.col("said").alias("text"), F.when(F.size(own) > 0, own).otherwise(F.col("end")).alias("cites"))


def section_texts(sections: DataFrame) -> DataFrame:
    """What answers an anchor, a row a text: a section's own anchor, and each of its cells' anchors: anchor, text."""
    stem = F.regexp_extract("anchor", "(?s)^(.*)!", 1)
    cells = sections.where("cells is not null").where(stem != "").select("anchor", "text", F.explode("cells").alias("ref"), stem.alias("stem"))
    cells = cells.select(F.concat_ws("!", "stem", "ref").alias("own"), "anchor", "text").where("own <> anchor")
    return sections.where("anchor <> ''").select("anchor", "text").unionByName(cells.select(F.col("own").alias("anchor"), "text"))


def dossier_texts(lines: DataFrame) -> DataFrame:
    """The rows of a dossier's first matter (matter, line) by the anchors they write, as they answer a citation: anchor, text."""
    parts = lines.where("matter = 1").select(F.explode(F.split(F.substring("line", F.lit(3), F.length("line")), r" \|\| ")).alias("text"))
    fields = parts.select("text", F.explode(F.split("text", r" \| ")).alias("field")).where(F.col("field").contains("#"))
    return fields.select(F.trim("field").alias("anchor"), "text").distinct()


def check_citations(reports: DataFrame, sections: DataFrame, indexed: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Failures of citations: doc, line, text, reason.

    Every sentence ends in a citation.  Every citation's anchor is one of the six kinds, its path is on a
    record of the index (doc), and it is a section or a cell; with a map (doc, path) the document named beside it
    is on it and has that path.
    """
    lines = body_lines(narrative(reports))
    bare = lines.select("doc", "line", F.explode(sentences(F.col("text"))).alias("text")).where(~R.is_cited(F.col("text")))
    failures = bare.select("doc", "line", "text", F.lit("the sentence ends in no citation").alias("reason"))
    cited = lines.select("doc", "line", "text", F.explode(R.citations(F.col("text"))).alias("c")).select("doc", "line", "text", F.col("c.doc").alias("named"), F.col("c.anchor").alias("anchor"))
    cited = cited.withColumn("path", A.parse_anchor(F.col("anchor"))["doc"])
    said = lambda rows, reason: rows.select("doc", "line", "text", reason.alias("reason"))
    failures = failures.unionByName(said(cited.where("path is null"), F.concat("anchor", F.lit(" is no anchor"))))
    whole = cited.where("path is not null")
    unknown = whole.join(indexed.select(F.col("doc").alias("path")).distinct(), "path", "left_anti")
    failures = failures.unionByName(said(unknown, F.concat("path", F.lit(" is on no record of the index"))))
    nowhere = whole.join(section_texts(sections).select("anchor").distinct(), "anchor", "left_anti")
    failures = failures.unionByName(said(nowhere, F.concat("anchor", F.lit(" is no section of the room"))))
    if mapping is not None:
        mapped = whole.join(mapping.select(F.col("doc").alias("named"), F.col("path").alias("its")), "named", "left")
        failures = failures.unionByName(said(mapped.where("its is null"), F.concat("named", F.lit(" is on no document of the map"))))
        failures = failures.unionByName(said(mapped.where("its <> path"), F.concat("named", F.lit(" is "), "its", F.lit(", not "), "path")))
    return failures


def check_numbers(reports: DataFrame, sections: DataFrame, dossier: DataFrame | None = None) -> DataFrame:
    """Numbers and days without a source: doc, line, text, reason.

    What a cited sentence claims must stand in a section it cites, or on a row of the dossier
    (matter, line) that cites that section; what a calculation counts with, in a cited sentence of its section
    of the report or in what these cite.  Numbers travel as rows, so no source gathers its texts.
    """
    cited = cited_sentences(reports).where(F.size("cites") > 0)
    keys = ["doc", "line", "at"]
    texts = section_texts(sections)
    if dossier is not None:
        texts = texts.unionByName(dossier_texts(dossier))
    held = texts.select("anchor", F.explode(F.array_union(carry.source_numbers(F.col("text")), carry.days_of(F.col("text")))).alias("value")).distinct()
    sources = cited.select(*keys, "section", F.explode("cites.anchor").alias("anchor")).distinct().join(held, "anchor")
    numbers, days = carry.sentence_numbers(F.col("text")), carry.days_of(R.strip_citations(F.col("text")))
    claims = cited.select(*keys, "section", "text", F.explode(F.array_union(numbers, days)).alias("value"))
    missing = claims.join(sources.select(*keys, "value").distinct(), [*keys, "value"], "left_anti")
    failures = missing.select("doc", "line", "text", F.concat("value", F.lit(" is in no cited section")).alias("reason"))
    room = sources.select("doc", "section", "value").unionByName(cited.select("doc", "section", F.explode(numbers).alias("value"))).distinct()
    sums = narrative(reports).withColumn("text", F.trim("text")).where(F.col("text").startswith(NO_SENTENCE[1]))
    operands = sums.select("doc", "line", "section", "text", F.explode(carry.calculation_operands(F.col("text"))).alias("value"))
    unknown = operands.join(room, ["doc", "section", "value"], "left_anti")
    return failures.unionByName(unknown.select("doc", "line", "text", F.concat("value", F.lit(" is on no cited sentence of the section")).alias("reason")))
