"""Shared folders, staged tables and small helpers of the operators here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole texts travel to Python in small batches.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
#: Besides, shuffle files go as soon as a staged table is written.
_WHILE_STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | SMALL_BATCHES


def tuned(spark: SparkSession) -> None:
    """Settings of a session that runs the queries or the pipeline here."""
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where none is set (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if not (own := getattr(spark, "_tessera_shared", None)):
        own = spark._tessera_shared = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return own


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here,
    and the shuffle files that made it are given back at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_STAGING}
    try:
        for k, v in _WHILE_STAGING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _staged(spark).append(path)
    return out


def _staged(spark: SparkSession) -> list[str]:
    """Paths of the session's staged tables that are still there."""
    if not hasattr(spark, "_tessera_staged"):
        spark._tessera_staged = []
    return spark._tessera_staged


def _delete(spark: SparkSession, paths: list[str]) -> None:
    have = _staged(spark)
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        if path in have:
            have.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later job reads: what was read from them is written."""
    for df in tables:
        _delete(df.sparkSession, [df._staged_at])


def discard_all(spark: SparkSession, before: set[str]) -> None:
    """Delete the staged tables of these paths that are still there."""
    _delete(spark, [p for p in _staged(spark) if p in before])


def staged_now(spark: SparkSession) -> set[str]:
    """Paths of the session's staged tables."""
    return set(_staged(spark))


#: Keys that are sent to every task at most; more are matched by a shuffled join.
BROADCAST_KEYS = 500_000


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is among the keys of a staged table of one column."""
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, key, "left_semi")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is null or not among the keys."""
    keys = staged(keys.where(f"{key} is not null").distinct(), "gone")
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, key, "left_anti")


def own_columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns that an operator needs, under its own names, so that
    extra columns of the input cannot clash with them.
    """
    return df.select(*(df[f"`{old}`"].alias(new) for new, old in names.items()))
