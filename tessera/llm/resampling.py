"""Importance resampling of documents towards a target distribution.

Both sides are counted as bags of hashed n-grams (runs of one to three words).
A bucket's gain is the log of how much more often the target holds it; a
document's weight is the sum of its features' gains; seeded Gumbel noise on
the weights makes the highest ones a draw without replacement.

The features are read by a byte automaton over the UTF-8 buffers of Arrow
columns: a table of 256 classes marks word bytes, differences of the marks are
the word boundaries, and the CRC of every word start in a block advances one
byte at a time in one numpy step, by a table of 256 entries.  No word becomes
a Python object.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import discard, own_columns, staged
from tessera.llm._text import ALNUM, LOWER, slices

#: Longest run of words that is a feature.
RUN = 3
#: Word starts whose CRCs advance together; and how few go on one by one, by zlib.
_BLOCK, _FEW = 1 << 16, 8
_FULL, _LOW, _EIGHT, _SPACE = np.uint32(0xFFFFFFFF), np.uint32(0xFF), np.uint32(8), np.uint32(0x20)


def _crc_table() -> np.ndarray:
    """The step table of the reflected CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each state after the bytes of its own piece [start, start + length).

    Pieces are taken longest first, so that those that still run are a prefix.
    The few longest go on by zlib, as a step for them alone would not pay.
    """
    order = np.argsort(-lengths, kind="stable")
    now, at, left = state[order], starts[order], lengths[order]
    steps = int(left[_FEW]) if len(left) > _FEW else 0
    for k, m in enumerate(np.searchsorted(-left, -np.arange(steps), side="left").tolist()):
        head = now[:m]
        now[:m] = _CRC[(head ^ data[at[:m] + k]) & _LOW] ^ (head >> _EIGHT)
    for i in range(min(_FEW, len(left))):
        rest = data[at[i] + steps : at[i] + left[i]]
        if len(rest):
            now[i] = zlib.crc32(rest.tobytes(), int(now[i] ^ _FULL)) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Where each text's words begin in the slice, and (first word, CRC) of all runs, block by block."""
    n = len(data)
    data = LOWER[data]
    # A word begins or ends where the class of a byte differs from its neighbour's, or a text does.
    marks = np.zeros(n + 1, dtype=np.int8)
    marks[:n] = ALNUM[data]
    step = np.diff(marks, prepend=np.int8(0))
    begins, ends = step == 1, step == -1
    cut = offsets[(offsets > 0) & (offsets < n)]
    cut = cut[(marks[cut] == 1) & (marks[cut - 1] == 1)]
    begins[cut] = ends[cut] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    of = np.searchsorted(starts, offsets)

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        after = np.repeat(of[1:], np.diff(of))
        for first in range(0, len(starts), _BLOCK):
            which = np.arange(first, min(first + _BLOCK, len(starts)))
            state = np.full(len(which), _FULL)
            for k in range(RUN):
                if k:
                    within = which + k < after[which]
                    which, state = which[within], state[within]
                    state = _CRC[(state ^ _SPACE) & _LOW] ^ (state >> _EIGHT)
                state = _advanced(state, data, starts[which + k], ends[which + k] - starts[which + k])
                yield which, state ^ _FULL

    return of, runs()


def _counted(buckets: int):
    """How many features of a task's texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                for _, crcs in _features(data, offsets)[1]:
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> list[int]:
    """Features of all rows in each bucket; one number per bucket reaches the driver."""
    rows = texts.select("text").mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(target's smoothed share / source's)) of each bucket."""
    s, t, k = float(sum(source)), float(sum(target)), len(source)
    return [math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source, target, strict=True)]


def _weighed(gain: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, dtype=np.int64)
        for batch in batches:
            n_words, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in slices(batch.column("text")):
                of, runs = _features(data, offsets)
                total = np.zeros(int(of[-1]) + 1, dtype=np.int64)
                for which, crcs in runs:
                    total[which + 1] += table[crcs % np.uint32(len(table))]
                weights.append(np.diff(np.cumsum(total)[of]))
                n_words.append(np.diff(of))
            n = np.concatenate(n_words)
            features = sum(np.maximum(n - k, 0) for k in range(RUN))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(features), pa.array(np.concatenate(weights))], names=["id", "n_words", "n_features", "weight"])

    return run


def _noise(id_: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths, from the first 8 hex digits of a SHA-256."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Weights of all documents, and the ranks of those drawn.

    Returns one row per input row: id, n_words, n_features, weight, score,
    rank.  Of the documents with `least_words` words or more, `percent` of a
    hundred (rounded down) with the highest scores are drawn, rank 1 first;
    the others' rank is null.  Ties go to the smaller id, rows that repeat an
    id and a score to fewer features.  A null or empty text has no features,
    weight 0, and is never drawn; a null id has the noise of an empty one and
    comes last among ties.  An empty target has T = 0 features, so that gains
    favour what is rare.  Words of any length and texts of any length are
    read whole.  Other columns are ignored.
    """
    texts = own_columns(docs, id=id_col, text=text_col)
    gain = gains(bucket_counts(texts, buckets), bucket_counts(own_columns(target, text=target_col), buckets))
    id_type = texts.schema["id"].dataType.simpleString()
    weighed = texts.mapInArrow(_weighed(gain), f"id {id_type}, n_words long, n_features long, weight long")
    # Written first, as a sort by ranges reads its input twice.
    scored = staged(weighed.withColumn("score", F.col("weight") + _noise(F.col("id"), seed)), "weighed")
    # A global order without a window of all rows: ranges are sorted apart, and each knows how many rows come before it.
    long_enough = F.col("n_words") >= least_words
    ranked = scored.orderBy(F.desc(long_enough), F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight")
    ranked = staged(ranked.withColumn("place", F.monotonically_increasing_id()), "resampled")
    discard(scored)
    part = F.shiftright("place", 33)
    sizes = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(long_enough).alias("able")).orderBy("part").collect()
    drawn = sum(r["able"] for r in sizes) * percent // 100
    before, known = 0, []
    for r in sizes:
        known.append((r["part"], before))
        before += r["n"]
    # One row for each range, of which there are as many as shuffle partitions.
    starts = ranked.sparkSession.createDataFrame(known, "part long, before long")
    place = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranked.withColumn("part", part).join(F.broadcast(starts), "part").select("id", "n_words", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
