"""Readers of rooms: folders of text, markdown, CSV and mail files as anchored sections.

Files are listed and read by Spark.  A file is parsed within its task by the
standard library where the format needs it (quoted newlines, mail headers);
sections, headings and everything after are DataFrame operations.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.sections import blocks, headed, lines
from tessera.sources.workbooks import workbook_sections

SUFFIXES = ("txt", "md", "csv", "eml", "mbox", "xlsx")
# Files at the root of a room that are not of it.
ROOM_FILES = ("brief.md", "key.json")
_ROWS = "doc string, kind string, ordinal long, anchor string, heading string, text string, cells array<string>"


def room_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc (path within the folder) and content of readable files; hidden and lock files, and the room's own brief and key, are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = F.lit(folder.rstrip("/").split("://", 1)[-1].lstrip("/"))
    path = F.regexp_replace("path", "^[a-z0-9]+:/+", "")
    doc = F.expr("substring(p, length(b) + 2)")
    named = files.withColumn("p", path).withColumn("b", base).select(doc.alias("doc"), "content")
    return named.where(F.lower("doc").rlike(rf"\.({'|'.join(SUFFIXES)})$") & ~F.col("doc").rlike(r"(^|/)(\.|~\$)") & ~F.col("doc").isin(*ROOM_FILES))


def room_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a room: doc (its id), path, place.

    A room with a key (key.json: an object with `documents`, id to path) has those, in the key's order; another one
    has all readable files, by path, under their paths as ids.
    """
    keys = spark.read.format("binaryFile").option("pathGlobFilter", "key.json").load(folder)
    listed = keys.select(F.from_json(F.decode("content", "UTF-8"), "documents map<string, string>")["documents"].alias("own")).where("own is not null")
    keyed = listed.select(F.posexplode(F.map_entries("own")).alias("at", "e")).select("e.key", "e.value", "at")
    if not keyed.isEmpty():
        return keyed.select(F.col("key").alias("doc"), F.col("value").alias("path"), (F.col("at") + 1).cast("int").alias("place"))
    own = room_files(spark, folder).select("doc")
    # The names of one room are ranked; its files are not read.
    return own.select("doc", F.col("doc").alias("path"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("doc")).alias("place"))


def text_sections(files: DataFrame) -> DataFrame:
    """Blocks of text and markdown files: doc, kind, ordinal, anchor, heading, text."""
    texts = files.where(F.lower("doc").rlike(r"\.(txt|md)$")).select("doc", F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n").alias("text"))
    own = headed(blocks(lines(texts, "doc")))
    ordinal = F.row_number().over(Window.partitionBy("doc").orderBy("line")).cast("long")
    return own.select("doc", F.lit("text").alias("kind"), ordinal.alias("ordinal"), F.concat("doc", F.lit("#l"), "line").alias("anchor"), "heading", "text", F.lit(None).cast("array<string>").alias("cells"))


def _messages(name: str, content: bytes) -> Iterator[tuple[str, email.message.EmailMessage]]:
    if name.lower().endswith(".eml"):
        yield "l", email.message_from_bytes(content, policy=email.policy.default)
        return
    for k, part in enumerate((p for p in re.split(rb"(?m)^From [^\n]*\n", content) if p.strip()), 1):
        yield f"m{k}l", email.message_from_bytes(part, policy=email.policy.default)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[dict] = []
        for name, content in zip(batch.column("doc").to_pylist(), batch.column("content").to_pylist(), strict=True):
            ordinal = 0

            def add(kind: str, anchor: str, heading: str | None, text: str, cells: list[str] | None = None, name: str = name) -> None:
                nonlocal ordinal
                ordinal += 1
                rows.append({"doc": name, "kind": kind, "ordinal": ordinal, "anchor": f"{name}#{anchor}", "heading": heading, "text": text, "cells": cells})

            if name.lower().endswith(".csv"):
                for k, cells in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline="")), 1):
                    if any(c.strip() for c in cells):
                        add("row", f"r{k}", None, " | ".join(cells), cells)
                continue
            for at, message in _messages(name, content):
                body = message.get_body(("plain", "html"))
                own = (body.get_content() if body else "").replace("\r\n", "\n").rstrip("\n").split("\n")
                heading = " | ".join(str(message[h]) for h in ("From", "To", "Date", "Subject") if message[h])
                # Headers come first, but are numbered after the body.
                for k, (header, value) in enumerate(message.items(), 1):
                    add("text", f"{at}{len(own) + k}", heading, f"{header}: {value}")
                block: list[str] = []
                for k, line in enumerate([*own, ""], 1):
                    if line.strip():
                        block.append(line)
                    elif block:
                        add("text", f"{at}{k - len(block)}", heading, "\n".join(block))
                        block = []
        kind = pa.schema([("doc", pa.string()), ("kind", pa.string()), ("ordinal", pa.int64()), ("anchor", pa.string()), ("heading", pa.string()), ("text", pa.string()), ("cells", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_pylist(rows, schema=kind)


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """All sections of a room: doc, kind (text or row), ordinal (from 1), anchor, heading, text, cells."""
    files = room_files(spark, folder)
    parsed = files.where(F.lower("doc").rlike(r"\.(csv|eml|mbox)$")).mapInArrow(_parsed, _ROWS)
    return text_sections(files).unionByName(parsed)


def typed_sections(spark: SparkSession, folder: str) -> DataFrame:
    """All sections of a room, workbooks too, as the typed index reads them: cells with their refs, and numbers where a workbook has numbers."""
    ref = F.transform("cells", lambda v, k: F.struct(F.concat(F.lit("r"), F.regexp_extract("anchor", "#r([0-9]+)$", 1), F.lit("c"), (k + 1).cast("string")).alias("ref"), v.alias("value"), F.lit(None).cast("double").alias("number")))
    plain = sections(spark, folder).select("doc", "ordinal", "kind", "heading", "anchor", "text", ref.alias("cells"))
    return plain.unionByName(workbook_sections(room_files(spark, folder)))


def write_records(records: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object per line, keys in order of name, rows in total order."""
    columns = sorted(records.columns)
    records.orderBy(*order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
