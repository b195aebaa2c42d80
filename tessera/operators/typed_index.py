"""The typed index of a room: seven kinds of values in one table, an occurrence a row.

Sections are doc (a path), ordinal (order within the document), kind (text or row), heading, anchor,
text, cells (array of ref, value and number; null for a text).  A number cell has a number, a text
cell none.  Occurrences are kind, value, unit, surface, doc, ordinal, n (order within the section),
anchor, context; `records` counts them, so that no value gathers its documents in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import anchors as A
from tessera.functions import dates as D
from tessera.functions.text import bound, context, following_unit, header_scale, header_unit
from tessera.functions.words import file_name, joined_to_a_token, mid_sentence, name_words, phrases
from tessera.operators import links
from tessera.operators.index import document_series

# How an amount is written, and what scales it.
_DIGITS = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?"
_SCALED = rf"(?:{_DIGITS})(?:(?:mm|bn|tn|[mkb])(?![A-Za-z0-9]))?"
WRITTEN_AMOUNT = rf"(?i)(?:\$\s?)?(?:\((?:{_SCALED})\)?|(?:{_SCALED}))(?:\s?(?:million|billion|thousand|trillion)\b)?(?:\s?%)?(?:[\s-]?(?:records?|months?|days?)\b)?"
_SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mm": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "tn": 1e12, "trillion": 1e12}
# Joined tokens, words that are names, words that say a status.
JOINED_TOKEN = r"\b[A-Za-z][A-Za-z0-9]*(?:[-_./][A-Za-z0-9]+)+\b"
NAME_WORD = r"\b[A-Z][A-Za-z]{2,}\b"
STATUS_WORDS = {"draft": "draft", "final": "final", "finalised": "final", "finalized": "final", "audited": "final", "redacted": "redacted", "privileged": "privileged", "confidential": "confidential"}
#: Sections at the head of a document that speak for it, and periods that make a series.
FRONT, LEAST_PERIODS = 10, 3

SECTIONS = "doc string, ordinal long, kind string, heading string, anchor string, text string, cells array<struct<ref: string, value: string, number: double>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern: array of struct(at: characters before it, surface)."""
    lengths = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda total, s: total + F.length(s))

    def placed(own: Column) -> Column:
        return F.transform(own["found"], lambda s, k: F.struct((lengths(own["gaps"], k + 1) + lengths(own["found"], k)).alias("at"), s.alias("surface")))

    return bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


def _is_number(text: Column) -> Column:
    return F.trim(text).rlike(r"^[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?$")


def line_tables(sections: DataFrame) -> DataFrame:
    """Rows of line tables: doc, ordinal, anchor, text, table, row (number within the table).

    A row is a text section of one line with ` | `, or of one number; consecutive ones are a table
    if one of them has a ` | `.
    """
    order = Window.partitionBy("doc").orderBy("ordinal")
    row = (F.col("kind") == "text") & F.col("cells").isNull() & ~F.col("text").contains("\n") & (F.col("text").contains(" | ") | _is_number(F.col("text")))
    # Sections before it that are no rows number an island; within one, places are consecutive.
    placed = sections.withColumns({"is_row": F.coalesce(row, F.lit(False))}).withColumns({"island": F.count(F.when(~F.col("is_row"), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)), "at": F.dense_rank().over(order)})
    whole = Window.partitionBy("doc", "island")
    tables = placed.where("is_row").withColumns({
        "row": F.col("at") - F.min("at").over(whole) + 1,
        "barred": F.max(F.col("text").contains(" | ")).over(whole),
        "table": F.concat(F.lit("lines"), F.min("ordinal").over(whole).cast("string")),
    })
    return tables.where("barred").select("doc", "ordinal", "anchor", "text", "table", "row")


def line_cells(tables: DataFrame) -> DataFrame:
    """Cells of line tables: doc, ordinal, anchor, context, table, row, column, place, text, number."""
    cells = tables.select("doc", "ordinal", "anchor", context(F.col("text")).alias("context"), "table", "row", F.posexplode(F.split("text", r" \| ")).alias("k", "field"))
    text = F.trim("field")
    number = F.when(_is_number(text), F.replace(text, F.lit(","), F.lit("")).cast("double"))
    return cells.select("doc", "ordinal", "anchor", "context", "table", "row", F.concat(F.lit("c"), F.col("k") + 1).alias("column"), (F.col("k") + 1).alias("place"), text.alias("text"), number.alias("number"))


def line_rows(sections: DataFrame) -> DataFrame:
    """The cells of the line tables of sections."""
    return line_cells(line_tables(sections))


def sheet_rows(sections: DataFrame) -> DataFrame:
    """Rows with cells, of sheets, csv files and tables on pages: doc, ordinal, anchor (the row's), own (the cell's), context, table, column, place, text, number."""
    table = A.table_of(F.col("anchor"))
    cells = sections.where("cells is not null").select("doc", "ordinal", "anchor", context(F.col("text")).alias("context"), table.alias("table"), F.posexplode("cells").alias("k", "cell"))
    own = F.when(A.parse_anchor(F.col("anchor"))["kind"] == "sheet-cell", A.cell_anchor(F.col("doc"), F.col("table"), F.col("cell.ref"), F.col("anchor"))).otherwise(F.col("anchor"))
    return cells.select("doc", "ordinal", "anchor", own.alias("own"), "context", "table", A.column_of(F.col("cell.ref")).alias("column"), (F.col("k") + 1).alias("place"), F.col("cell.value").alias("text"), F.col("cell.number").alias("number"))


def column_headers(cells: DataFrame) -> DataFrame:
    """Of each table, its last row without a number above the first one with: doc, table, column, header."""
    rows = cells.groupBy("doc", "table", "ordinal").agg(F.max(F.col("number").isNotNull()).alias("numeric"))
    first = rows.where("numeric").groupBy("doc", "table").agg(F.min("ordinal").alias("first"))
    above = rows.where("not numeric").join(first, ["doc", "table"]).where("ordinal < first").groupBy("doc", "table").agg(F.max("ordinal").alias("ordinal"))
    return cells.join(above, ["doc", "table", "ordinal"]).groupBy("doc", "table", "column").agg(F.min_by("text", "place").alias("header"))


def text_pieces(sections: DataFrame) -> DataFrame:
    """What is read as text: doc, ordinal, piece, text, anchor, context.

    A text section is one piece with its heading before it; a row is one piece for each text cell.
    """
    said = F.when(F.coalesce("heading", F.lit("")) != "", F.concat_ws("\n", "heading", "text")).otherwise(F.col("text"))
    plain = sections.where("cells is null").select("doc", "ordinal", F.lit(0).alias("piece"), said.alias("text"), "anchor", context(F.col("text")).alias("context"))
    cells = sheet_rows(sections).where("number is null and text is not null").select("doc", "ordinal", F.col("place").alias("piece"), "text", F.col("own").alias("anchor"), "context")
    return plain.unionByName(cells)


def _found(pieces: DataFrame, kind: str, hits: Column, value: Column, unit: Column) -> DataFrame:
    """Occurrences from an array of hits, each with at and surface."""
    rows = pieces.select("doc", "ordinal", "piece", "anchor", "context", "text", F.explode(hits).alias("hit"))
    return rows.select(F.lit(kind).alias("kind"), value.alias("value"), unit.cast("string").alias("unit"), F.trim("hit.surface").alias("surface"), "doc", "ordinal", (F.col("piece").cast("long") * 1_000_000 + F.col("hit.at")).alias("n"), "anchor", "context")


def number_text(number: Column) -> Column:
    """A number as text: without a fraction where it has none."""
    return F.when(number == F.floor(number), F.format_string("%.0f", number)).otherwise(F.regexp_replace(F.format_string("%.6f", number), "0+$", ""))


def dates(pieces: DataFrame) -> DataFrame:
    hits = F.filter(matches(F.col("text"), D.WRITTEN_DAY), lambda h: D.iso_of(h["surface"]).isNotNull())
    return _found(pieces, "date", hits, D.iso_of(F.col("hit.surface")), F.lit(None))


def amount_parts(surface: Column) -> tuple[Column, Column]:
    """Value and unit of a written amount: USD, percent, records, months, days, or none."""
    number = F.replace(F.regexp_extract(surface, _DIGITS, 0), F.lit(","), F.lit("")).cast("double")
    word = F.lower(F.regexp_extract(surface, r"(?i)[0-9)]\s?(million|billion|thousand|trillion)\b", 1))
    letter = F.lower(F.regexp_extract(surface, r"(?i)[0-9](mm|bn|tn|[mkb])(?![A-Za-z0-9])", 1))
    scales = F.create_map(*(F.lit(x) for kv in _SCALES.items() for x in kv))
    scale = F.coalesce(F.try_element_at(scales, F.when(letter != "", letter).otherwise(word)), F.lit(1.0))
    named = F.lower(F.regexp_extract(surface, r"(?i)(record|month|day)s?$", 1))
    return number * scale, F.when(surface.contains("$"), "USD").when(surface.contains("%"), "percent").when(named != "", F.concat(named, F.lit("s")))


def amounts(sections: DataFrame, pieces: DataFrame, line_cells: DataFrame) -> DataFrame:
    """Amounts of texts, of text fields of line rows, and of number cells.

    The unit is the surface's own, else that of the words behind it, or for a cell the one of its
    column's header, whose scale counts too; else a whole number is a count.
    """
    of_lines = line_cells.where("number is null").select("doc", "ordinal", F.col("place").alias("piece"), "text", "anchor", "context")
    rest = pieces.join(line_cells.select("doc", "ordinal").distinct(), ["doc", "ordinal"], "left_anti").select("doc", "ordinal", "piece", "text", "anchor", "context")
    # Dealt evenly: what is read from few files would else be read by few tasks, which takes longer than all the rest.
    dealt = rest.unionByName(of_lines).repartition("doc", "ordinal", "piece").withColumn("masked", D.mask_days(F.col("text")))
    hits = F.filter(matches(F.col("masked"), WRITTEN_AMOUNT), lambda h: ~joined_to_a_token(F.substring(F.col("text"), F.greatest(h["at"] - 1, F.lit(1)), F.least(h["at"], F.lit(2)))))
    surface = F.trim("hit.surface")
    value, unit = amount_parts(F.col("surface"))
    # Trailing white space of a surface is never part of it, so the words behind begin where it ends.
    behind = following_unit(F.substring(F.col("text"), F.col("hit.at") + F.length("hit.surface") + 1, F.lit(60)))
    rows = dealt.select("doc", "ordinal", "piece", "anchor", "context", "text", F.explode(hits).alias("hit")).withColumn("surface", surface)
    # Columns of their own, as each is asked for several times.
    rows = rows.withColumns({"number": value, "written": unit, "behind": behind})
    unit = F.coalesce("written", "behind", F.when(F.col("number") == F.floor("number"), "count"))
    said = rows.select(F.lit("amount").alias("kind"), number_text(F.col("number")).alias("value"), unit.alias("unit"), "surface", "doc", "ordinal", (F.col("piece").cast("long") * 1_000_000 + F.col("hit.at")).alias("n"), "anchor", "context")
    sheets = sheet_rows(sections).where(A.parse_anchor(F.col("anchor"))["kind"] == "sheet-cell").withColumn("row_anchor", F.col("own"))
    both = sheets.select("doc", "ordinal", "table", "column", "place", "text", "number", "row_anchor", "context").unionByName(line_cells.select("doc", "ordinal", "table", "column", "place", "text", "number", F.col("anchor").alias("row_anchor"), "context"))
    headed = both.where("number is not null").join(column_headers(both), ["doc", "table", "column"], "left").withColumn("header", F.coalesce("header", F.lit("")))
    scaled = F.col("number") * header_scale(F.col("header"))
    told = F.coalesce(header_unit(F.col("header")), F.when(scaled == F.floor(scaled), "count"))
    cells = headed.select(F.lit("amount").alias("kind"), number_text(scaled).alias("value"), told.alias("unit"), F.trim("text").alias("surface"), "doc", "ordinal", (F.col("place").cast("long") * 1_000_000).alias("n"), F.col("row_anchor").alias("anchor"), "context")
    return said.unionByName(cells)


def names(pieces: DataFrame, least_docs: int = 2) -> DataFrame:
    """Capitalised names of two to four words; and single words that stand within a sentence in several documents, wherever they stand."""
    runs = F.transform(phrases(F.col("text")), lambda p, k: F.struct(k.alias("at"), p.alias("surface")))
    many = _found(pieces, "name", runs, F.col("hit.surface"), F.lit(None))
    rows = pieces.select("doc", "ordinal", "piece", "anchor", "context", "text", F.explode(matches(F.col("text"), NAME_WORD)).alias("hit"))
    words = rows.select("doc", "ordinal", "piece", "anchor", "context", F.col("hit.surface").alias("surface"), F.col("hit.at").alias("at"), mid_sentence(F.substring(F.col("text"), F.lit(1), F.col("hit.at"))).alias("mid"))
    known = words.where("mid").groupBy("surface").agg(F.countDistinct("doc").alias("m")).where(F.col("m") >= least_docs).select("surface")
    single = words.join(known, "surface", "left_semi").select(F.lit("name").alias("kind"), F.col("surface").alias("value"), F.lit(None).cast("string").alias("unit"), "surface", "doc", "ordinal", (F.col("piece").cast("long") * 1_000_000 + 500_000 + F.col("at")).alias("n"), "anchor", "context")
    return many.unionByName(single)


def identifiers(pieces: DataFrame) -> DataFrame:
    hits = F.filter(matches(F.col("text"), JOINED_TOKEN), lambda h: h["surface"].rlike("[0-9]"))
    return _found(pieces, "identifier", hits, F.col("hit.surface"), F.lit(None))


def front_sections(sections: DataFrame) -> DataFrame:
    """Leading text sections without a heading, at most so many."""
    order = Window.partitionBy("doc").orderBy("ordinal")
    stop = F.max(((F.col("kind") != "text") | F.col("heading").isNotNull()).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("stop", stop).withColumn("nth", F.row_number().over(order)).where((F.col("stop") == 0) & (F.col("nth") <= FRONT)).drop("stop", "nth")


def document_starts(sections: DataFrame) -> DataFrame:
    """The documents with the anchor of their first section: doc, anchor.

    They are written, as what is asked of a document's name would else be asked for each of its sections.
    """
    return links.written(sections.groupBy("doc").agg(F.min_by("anchor", "ordinal").alias("anchor")), "starts")


def statuses(sections: DataFrame, starts: DataFrame) -> DataFrame:
    """The statuses that documents claim: the first capitalised word of each in the front matter, else in the file name."""
    front = front_sections(sections).select("doc", "ordinal", "anchor", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    named = starts.select("doc", F.lit(1 << 40).alias("ordinal"), "anchor", F.lit(0).alias("line"), name_words(F.col("doc")).alias("said"), file_name(F.col("doc")).alias("context"))
    lines = front.select("doc", "ordinal", "anchor", "line", "said", F.col("said").alias("context")).unionByName(named)
    hits = F.filter(matches(F.col("said"), rf"(?i)\b(?:{'|'.join(STATUS_WORDS)})\b"), lambda h: h["surface"].rlike("^[A-Z]"))
    values = F.create_map(*(F.lit(x) for kv in STATUS_WORDS.items() for x in kv))
    every = lines.select("doc", "ordinal", "anchor", "line", "context", F.explode(hits).alias("hit")).withColumn("value", values[F.lower("hit.surface")])
    first = every.groupBy("doc", "value").agg(F.min(F.struct("ordinal", "line", "hit.at", "hit.surface", "anchor", "context")).alias("x"))
    return first.select(F.lit("status").alias("kind"), "value", F.lit(None).cast("string").alias("unit"), F.col("x.surface").alias("surface"), "doc", F.col("x.ordinal").alias("ordinal"), F.lit(0).cast("long").alias("n"), "x.anchor", F.trim("x.context").alias("context"))


def first_days(sections: DataFrame) -> DataFrame:
    """The first day that a document's front matter names: doc, day."""
    lines = front_sections(sections).select("doc", "ordinal", F.posexplode(F.split("text", "\n")).alias("line", "said")).withColumn("day", D.first_day(F.col("said"))).where("day is not null")
    return lines.groupBy("doc").agg(F.min_by("day", F.struct("ordinal", "line")).alias("day"))


def version_pairs(sections: DataFrame, starts: DataFrame, idents: DataFrame, nameds: DataFrame, status: DataFrame) -> DataFrame:
    """A draft and its final, two occurrences a pair; the value is `draft -> final`, the surface the identifier that names it.

    They share an identifier, or a name of one word in capitals, under which they alone are a
    draft before a final; the one that fewest documents carry names the pair.  Documents in two
    pairs are in none.  Pairs under one identifier are counted by a running sum, never made.
    """
    code = nameds.where(~F.col("value").contains(" ") & (F.col("value") == F.upper("value")))
    held = idents.select("value", "doc").unionByName(code.select("value", "doc")).distinct()
    carried = held.groupBy("value").agg(F.count("*").alias("carriers")).where("carriers > 1")
    claims = status.where("value in ('draft', 'final')").select("doc", F.col("value").alias("status"))
    dated = held.join(carried, "value").join(claims, "doc").join(first_days(sections), "doc")
    before = Window.partitionBy("value").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    days = dated.withColumn("day", F.unix_date(F.to_date("day")))
    draft = F.col("status") == "draft"
    seen = days.withColumn("earlier", F.count(F.when(draft, 1)).over(before)).withColumn("draft", F.min(F.when(draft, F.struct("day", "doc"))).over(before))
    one = seen.where("status = 'final'").groupBy("value", "carriers").agg(F.sum("earlier").alias("pairs"), F.max_by(F.struct("draft.doc", "draft.day", F.col("doc").alias("final"), F.col("day").alias("final_day")), "earlier").alias("x")).where("pairs = 1")
    named = one.groupBy(F.col("x.doc").alias("draft"), F.col("x.final").alias("final"), F.col("x.day").alias("draft_day"), F.col("x.final_day").alias("final_day")).agg(F.min(F.struct("carriers", "value")).alias("x"))
    twice = named.select(F.explode(F.array("draft", "final")).alias("doc")).groupBy("doc").agg(F.count("*").alias("m")).where("m > 1")
    for end in ("draft", "final"):
        named = named.join(twice.select(F.col("doc").alias(end)), end, "left_anti")
    text = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    said = F.concat("x.value", F.lit(", draft "), text("draft_day"), F.lit(" and final "), text("final_day"))
    rows = named.select(F.concat_ws(" -> ", "draft", "final").alias("value"), F.col("x.value").alias("surface"), said.alias("context"), F.explode(F.array("draft", "final")).alias("doc"))
    return rows.join(starts, "doc").select(F.lit("version-pair").alias("kind"), "value", F.lit(None).cast("string").alias("unit"), "surface", "doc", F.lit(0).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("n"), "anchor", "context")


def row_series(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns of tables that step by one week, month or quarter: doc, table, column, step, n, first, last, surface, anchor, from_row, to_row.

    Tables are those of lines; sheets are taken from the sections.  The surface is what stands one
    row above the first period in that column, else the column.  Rows are read twice: all for
    their periods, then those above a series only.
    """
    fields = ("doc", "table", "row", "column", "place", "text", "anchor")
    sheets = sheet_rows(sections).where("table is not null and column is not null").withColumn("row", F.dense_rank().over(Window.partitionBy("doc", "table").orderBy("ordinal")))
    cells = sheets.select(*fields, "number").unionByName(line_cells(tables).select(*fields, "number"))
    order = Window.partitionBy("doc", "table", "column").orderBy("row", "place")
    found = cells.where("number is null").select("doc", "table", "column", "row", "place", "anchor", D.period(F.col("text")).alias("period")).where("period is not null")
    found = found.withColumn("prior", F.lag("period").over(order)).withColumn("step", F.when(F.col("prior").isNotNull(), F.coalesce(D.step_between(F.col("prior"), F.col("period")), F.lit("none"))))
    runs = found.groupBy("doc", "table", "column").agg(
        F.count("*").alias("n"), F.min("step").alias("step"), F.max("step").alias("most"), F.min_by("period", F.struct("row", "place")).alias("first"), F.max_by("period", F.struct("row", "place")).alias("last"),
        F.min("row").alias("from_row"), F.max("row").alias("to_row"), F.min_by("anchor", F.struct("row", "place")).alias("own"),
    )
    runs = links.written(runs.where((F.col("n") >= LEAST_PERIODS) & (F.col("step") == F.col("most")) & (F.col("step") != "none")), "runs")
    wanted = runs.select("doc", "table", (F.col("from_row") - 1).alias("row")).distinct()
    above = sheets.select(*fields).unionByName(line_cells(tables.join(wanted, ["doc", "table", "row"], "left_semi")).select(*fields))
    above = above.where(F.trim("text") != "").select("doc", "table", "column", (F.col("row") + 1).alias("from_row"), F.struct(F.trim("text").alias("text"), "anchor").alias("cell"), "place")
    above = above.groupBy("doc", "table", "column", "from_row").agg(F.min_by("cell", "place").alias("header"))
    runs = runs.join(above, ["doc", "table", "column", "from_row"], "left")
    return runs.select("doc", "table", "column", "step", "n", D.period_text(F.col("first")).alias("first"), D.period_text(F.col("last")).alias("last"), F.coalesce("header.text", "column").alias("surface"), F.coalesce("header.anchor", "own").alias("anchor"), "from_row", "to_row")


def series(sections: DataFrame, starts: DataFrame, tables: DataFrame) -> DataFrame:
    """Series of rows and of documents as occurrences: the value says step, form and extent."""
    rows = row_series(sections, tables)
    extent = lambda what: F.concat(F.col("n").cast("string"), F.lit(" "), F.col("step"), F.lit(f" {what} from "), F.col("first"), F.lit(" to "), F.col("last"))
    value = lambda form, where: F.concat_ws(" ", "step", F.lit(form), where)
    none = F.lit(None).cast("string").alias("unit")
    own = rows.select(F.lit("series").alias("kind"), value("rows", F.concat_ws("/", "doc", "table", "column")).alias("value"), none, "surface", "doc", F.lit(0).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("n"), "anchor", extent("rows").alias("context"))
    found = document_series(starts.select("doc"))
    member = starts.withColumn("x", D.name_period(F.col("doc"))).where("x is not null").select("doc", "anchor", F.col("x.before").alias("before"), F.col("x.after").alias("after"))
    joined = member.join(found, ["before", "after"])
    families = joined.select(F.lit("series").alias("kind"), value("documents", F.concat_ws("*", "before", "after")).alias("value"), none, F.col("stem").alias("surface"), "doc", F.lit(0).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("n"), "anchor", extent("documents").alias("context"))
    return own.unionByName(families)


def build_index(sections: DataFrame) -> DataFrame:
    """All occurrences of all seven kinds: date, amount, name, identifier, status, version-pair, series."""
    pieces, tables = links.written(text_pieces(sections), "pieces"), links.written(line_tables(sections), "line-tables")
    lines, starts = links.written(line_cells(tables), "line-cells"), document_starts(sections)
    idents, nameds, status = links.written(identifiers(pieces), "identifiers"), links.written(names(pieces), "names"), links.written(statuses(sections, starts), "statuses")
    kinds = [dates(pieces), amounts(sections, pieces, lines), nameds, idents, status, version_pairs(sections, starts, idents, nameds, status), series(sections, starts, tables)]
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more)
    return out


def records(occurrences: DataFrame) -> DataFrame:
    """One row for each kind, value and unit: n, n_docs, and surface, anchor and context of the first occurrence."""
    first = F.min_by(F.struct("surface", "anchor", "context"), F.struct("doc", "ordinal", "n"))
    return occurrences.groupBy("kind", "value", "unit").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"), first.alias("x")).select("kind", "value", "unit", "n", "n_docs", "x.surface", "x.anchor", "x.context")


def series_numbers(sections: DataFrame) -> DataFrame:
    """The row series read back as numbers: series, doc, column, at (day), value, anchor.

    Kept are series whose rows all begin with a day, and of these the columns that hold a number
    in every row.
    """
    tables = links.written(line_tables(sections), "line-tables")
    found = links.written(row_series(sections, tables).select("doc", "table", F.col("column").alias("periods"), "surface", "n"), "row-series")
    sheets = sheet_rows(sections).where("table is not null").select("doc", "table", "ordinal", "anchor", "column", "place", "text", "number")
    lines = line_cells(tables.join(found, ["doc", "table"], "left_semi")).select("doc", "table", "ordinal", "anchor", "column", "place", "text", "number")
    # All that follows is within a series, so that its cells are shuffled once.
    cells = sheets.unionByName(lines).repartition("doc", "table").join(found, ["doc", "table"])
    row, column, whole = (Window.partitionBy("doc", "table", "periods", *by) for by in (("ordinal",), ("place",), ()))
    # Members are the rows with a period in the series' column; they lead with what stands first.
    period = (F.col("column") == F.col("periods")) & D.period(F.col("text")).isNotNull()
    day = F.when(F.col("place") == 1, D.iso_of(F.regexp_extract("text", r"^\s*([^T]*?)(?:[T ][0-9:]+.*)?$", 1)))
    members = cells.withColumns({"period": period, "day": day}).withColumns({"member": F.max("period").over(row), "at": F.max("day").over(row)}).where("member")
    counted = members.withColumn("dated", F.count("day").over(whole)).withColumn("held", F.count("number").over(column))
    out = counted.where("dated = n and held = n and place > 1")
    return out.select(F.concat_ws("/", "doc", "table", "periods").alias("series"), "surface", "doc", "column", F.to_date("at").alias("at"), F.col("number").alias("value"), "anchor")
