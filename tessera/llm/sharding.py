"""Two-pass external shuffle into shards.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded
hash.  Pass 2 loads one bucket at a time, shuffles it with Fisher-Yates under
a seed of its own, and writes it.  A bucket's place among all records is known
from the bucket sizes, so every record has a place in one global random
order; a shard is one of the equal stretches of that order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._tables import own_columns, staged

#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Rows alike in id and text beyond which they are dealt to several buckets.
MANY_ALIKE = 1000
#: Buckets whose places are summed up together.
_GROUP = 1 << 12

_SHUFFLED = "id long, text string, bucket long, place long"


def _fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniformly random order of n: every place, from the last, swaps with one not after it."""
    rng = np.random.default_rng(seed)
    order = np.arange(n)
    picks = rng.integers(0, np.arange(n, 0, -1)) if n else order
    for k, pick in zip(range(n - 1, 0, -1), picks.tolist(), strict=False):
        order[k], order[pick] = order[pick], order[k]
    return order


def _shuffled(seed: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows = rows.take(pc.sort_indices(rows.select(["id", "tie"]), sort_keys=[("id", "ascending"), ("tie", "ascending")]))
        order = _fisher_yates(rows.num_rows, [seed, bucket])
        place = np.empty(rows.num_rows, dtype=np.int64)
        place[order] = np.arange(rows.num_rows)
        return pa.table({"id": rows["id"].cast(pa.int64()), "text": rows["text"], "bucket": rows["bucket"], "place": pa.array(place)})

    return run


def shuffle_into_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the records in random order to `path`, a folder per shard, and return them.

    Returns id, text, shard, slot (place in the shard, gapless from 0).  Shard
    sizes differ by one row at most.  The same rows, seed and bucket_bytes
    always give the same result.

    Null ids and texts are records like others.  Rows that are alike in both
    are interchangeable; where there are many, they are dealt out evenly, by
    their place in the files.  An empty table writes no rows.  Other columns
    are ignored.
    """
    source = own_columns(docs, id=id_col, text=text_col)
    total = source.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    buckets = 1 + int(total) // bucket_bytes
    source = source.withColumn("tie", F.xxhash64("text"))
    alike = staged(source.groupBy("id", "tie").agg(F.count("*").alias("n")).where(F.col("n") > MANY_ALIKE).select(F.col("id").alias("i"), F.col("tie").alias("t")), "alike")
    dealt = lambda df, *salt: df.select("id", "text", "tie", F.pmod(F.xxhash64("id", "tie", F.lit(seed), *salt), F.lit(buckets)).alias("bucket"))
    if alike.isEmpty():
        source = dealt(source)
    else:
        marked = source.join(alike, F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left")
        # Written, as the numbers of rows are not the same in every job.
        source = staged(dealt(marked, F.when(F.col("t").isNotNull(), F.monotonically_increasing_id())), "dealt")
    sizes = staged(source.groupBy("bucket").agg(F.count("*").alias("n")), "sizes")
    count = sizes.agg(F.sum("n")).first()[0] or 0
    # Running sums of groups of buckets, then of buckets within a group.
    sizes = sizes.withColumn("group", F.floor(F.col("bucket") / _GROUP))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(Window.orderBy("group")).alias("first"))
    bases = sizes.select("bucket", "group", before(Window.partitionBy("group").orderBy("bucket")).alias("inside")).join(groups, "group").select("bucket", (F.col("first") + F.col("inside")).alias("base"))
    shuffled = source.repartition("bucket").groupBy("bucket").applyInArrow(_shuffled(seed), _SHUFFLED)
    at = F.col("base") + F.col("place")
    first = lambda shard: F.expr(f"({shard} * {count} + {shards - 1}) div {shards}")
    placed = shuffled.join(bases, "bucket").select("id", "text", at.alias("at")).withColumn("shard", F.expr(f"cast(at * {shards} div {max(count, 1)} as int)"))
    placed.select("id", "text", "shard", (F.col("at") - first("shard")).alias("slot")).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema("id long, text string, slot long, shard int").parquet(path).select("id", "text", "shard", "slot")
