"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's docs.  All but the last return the columns
of `documents`.  Rows with a null doc_id cannot be named in a decision and
stay; of rows that repeat a doc_id, all go if one is rejected, and in the
near-duplicate stage one of each different text stays.  A null or empty text
has no words: it is judged by its site, is nobody's near duplicate, holds no
passage, and is packed as one token.  An empty table passes through as empty,
other columns of the input are dropped.

What a stage writes to the shared folder is deleted when the next stage of the
same tables begins, as its result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._tables import discard, discard_all, staged, staged_now, table, tuned, without
from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.packing import pack
from tessera.llm.quality import judge_quality
from tessera.llm.queries import packed_digest
from tessera.llm.repeats import remove_repeats

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects, as poor or as toxic, go."""
    judged = judge_quality(docs, table(spark, sf_dir, "labels"), host_col="source", path_col="lang")
    return without(docs.select(_COLUMNS), judged.where("not keep").select(F.col("id").alias("doc_id")), "doc_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingle sets of similarity 0.8 or more, the one with the smallest id stays."""
    members, _ = jaccard_join(docs, n_words=5, percent=80)
    kept = without(docs.select(_COLUMNS), members.where("id <> component").select(F.col("id").alias("doc_id")), "doc_id")
    twice = staged(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    # Rows that repeat an id are told apart by their texts: copies go, other texts stay.
    again = kept.join(twice, "doc_id").groupBy("doc_id", "text").agg(F.min(F.struct(*_COLUMNS)).alias("row"))
    return without(kept, twice, "doc_id").unionByName(again.select("row.*"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more, in 200 bytes at least, that occur more than once are cut out wherever
    they do; documents of which nothing is left go.
    """
    cut = remove_repeats(docs, length=200, carry=["lang", "source", "n_chars"], least_words=50)
    return cut.where("n_removed = 0 or text <> ''").select(F.col("id").alias("doc_id"), "text", "carry.lang", "carry.source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("carry.n_chars")).alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)
    return without(docs.select(_COLUMNS), found.where("n_hit > 0").select(F.col("id").alias("doc_id")), "doc_id")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences whose windows mirror the mixture of sources."""
    return packed_digest(pack(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN))


#: By application and folder: what the stage before has left in the shared folder.
_LEFT: dict[tuple[str, str], set[str]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tuned(spark)
        of = (spark.sparkContext.applicationId, sf_dir)
        left = _LEFT.pop(of, set())
        if left:
            read = " ".join(docs.inputFiles())
            discard_all(spark, {p for p in left if p.rsplit("/", 1)[-1] not in read})
        before = staged_now(spark)
        out = f(spark, docs, sf_dir)
        _LEFT[of] = staged_now(spark) - before
        return out

    return run_stage


STAGES = [
    ("quality classifier", _stage(quality)),
    ("n-gram Jaccard join", _stage(near_duplicates)),
    ("suffix-array dedup", _stage(repeated_strings)),
    ("benchmark decontamination", _stage(benchmark_passages)),
    ("packing", _stage(packing)),
]

#: Neither the classifier nor the suffix array nor BPE can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "stage")
            if k:
                discard(before)
    return docs
