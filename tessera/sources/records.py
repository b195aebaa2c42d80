"""Records of a room on disk: JSON lines, notes, maps, and the tables made from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "doc string, ordinal int, kind string, anchor string, heading string, text string, warning string, cells array<struct<ref:string,value:string>>"
NOTE = (
    "doc string, model string, what string, flags array<struct<flag:string,quote:string,consequence:string,about:array<string>,anchor:string>>, figures array<struct<surface:string,quote:string,anchor:string>>, "
    "cross_references array<struct<kind:string,value:string,quote:string,anchor:string>>, concealed array<struct<claim:string,quote:string,anchor:string>>"
)
#: Lists of a note, as tables of rows (doc, seq, ...).
LISTS = ("flags", "figures", "cross_references", "concealed")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def read_notes(spark: SparkSession, path: str, docs: DataFrame) -> dict[str, DataFrame]:
    """Notes (one JSON file each) on known documents (path, doc), as a table for each of their lists."""
    notes = spark.read.schema(NOTE).option("multiLine", True).json(path).withColumnRenamed("doc", "path").join(docs, "path")
    return {name: notes.select("doc", F.posexplode(name).alias("seq", "x")).select("doc", "seq", "x.*") for name in LISTS}


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a map: doc, path, date."""
    return spark.read.schema("documents array<struct<doc:string,path:string,date:string>>").option("multiLine", True).json(path).select(F.explode("documents").alias("x")).select("x.*")


def read_pinned(spark: SparkSession, path: str, digest: str, schema: str) -> DataFrame:
    """JSON lines of a file whose content has this SHA-256; another content fails the job."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.when(F.sha2("content", 256) == digest, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("unexpected content of "), "path")).cast("string"))
    lines = raw.select(F.explode(F.split(text, "\n")).alias("line")).where(F.trim("line") != "")
    return lines.select(F.from_json("line", schema).alias("x")).select("x.*")


def write_index(records: DataFrame, path: str) -> None:
    """Index records (kind, value, anchors, ...) as JSON lines by kind, value and first anchor, in parts that follow one another."""
    own = records.withColumn("first", F.get("anchors", F.lit(0))).withColumn("sorted_value", F.to_json(F.struct("value")))
    ordered = own.orderBy("kind", "sorted_value", "first")
    ordered.select(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_map(documents: DataFrame, edges: DataFrame, path: str, matters: DataFrame | None = None, ranked: DataFrame | None = None) -> None:
    """Documents, edges and, if given, matters and their ranked documents as folders of JSON lines below one path."""
    documents.orderBy("doc").write.json(f"{path}/documents")
    edges.orderBy("a", "b", "kind", "value").write.json(f"{path}/edges")
    if matters is not None:
        matters.orderBy("matter").write.json(f"{path}/matters")
    if ranked is not None:
        ranked.orderBy("matter", "place").write.json(f"{path}/ranked")


def write_evidence(rows: DataFrame, path: str) -> None:
    """Rows (document, date, quote, citation) as CSV with a header and CRLF line ends, each file with a byte order mark."""
    quoted = lambda c: F.when(F.coalesce(c, F.lit("")).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    line = F.concat_ws(",", *(quoted(F.col(c)) for c in ("document", "date", "quote", "citation")))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = ["\ufeffdocument,date,quote,citation"]
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": [*head, *batch.column("value").to_pylist()]})
            head = []
        if head:
            yield pa.RecordBatch.from_pydict({"value": head})

    rows.select(line.alias("value")).mapInArrow(marked, "value string").write.option("lineSep", "\r\n").text(path)


def section_records(sections: DataFrame) -> DataFrame:
    """Sections as the JSON lines of a run, keys in order: value.  A text has no key for cells, other nulls are written."""
    plain = [c for c in sorted(sections.columns) if c != "cells"]
    text = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
    if "cells" not in sections.columns:
        return sections.select(text.alias("value"))
    cells = F.concat(F.lit(',"cells":'), F.to_json("cells"))
    where = F.concat(F.regexp_extract(F.to_json(F.struct("anchor"), {"ignoreNullFields": "false"}), r"(?s)^(.*)\}$", 1), cells, F.lit(","), F.substring(F.to_json(F.struct(*(c for c in plain if c != "anchor")), {"ignoreNullFields": "false"}), F.lit(2), F.lit(1 << 30)))
    return sections.select(F.when(F.col("cells").isNull(), text).otherwise(where).alias("value"))


def write_documents(lines: DataFrame, path: str) -> None:
    """Lines (doc, line, text) of generated documents, in order, a folder for each document."""
    lines.repartitionByRange("doc", "line").sortWithinPartitions("doc", "line").select("doc", "text").write.partitionBy("doc").text(path)
