"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents, a stream of tokens.  A window is a fixed
number of sequences.  Per window every queue is due its target share of the
window's tokens; what rounding leaves undone is carried to the next window.  A
queue that runs out gives its share to the others, in proportion.

While the same queues are open, what a queue has given after t windows is a
closed formula: its whole tokens per window, and one more in some windows of
every cycle.  So a document's place follows from its
offset in its own queue, and no task has to walk through the windows before
it.  The driver handles only the moments at which a queue runs out, at most
one for each source.  Offsets in queues come from sums per source and hashed
bucket, then from running sums within a bucket.

Documents are cut at window and sequence ends, so only the very last sequence
is not full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._tables import own_columns, staged
from tessera.llm._text import small
from tessera.llm.tokens import encoded

#: Queues of one schedule at most; the smallest of further sources share queues.
MOST_QUEUES = 1024
#: Tokens of a bucket, within which offsets are running sums.
BUCKET_TOKENS = 2_000_000
#: Windows within which the fractions of a quantum are evened out.
CYCLE = 64

_TOKENS = "id long, queue string, h long, n long, ids binary"
_PIECES = "id long, queue string, start long, length long, ids binary, doc_tokens long, window long, sequence_id long, offset long"


def _tokenised(ranks_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids = [x.tobytes() + b"\0\0" for x in encoded(batch.column(3), ranks_file, pattern)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "queue", "h", "n", "ids"],
            )

    return run


class Phase:
    """Windows first, first + 1, ... during which the same queues are open.

    A queue's quantum is q + f / CYCLE tokens.  It gives q tokens per window,
    and one more in f of every CYCLE windows; the queues' extra windows lie
    side by side on the cycle, so all windows are full.
    """

    def __init__(self, first: int, size: int, weights: list[int]) -> None:
        total, units = sum(weights), size * CYCLE
        dues = [max(1, units * w // total) for w in weights]
        dues[weights.index(max(weights))] += units - sum(dues)
        self.first = first
        self.whole, self.part = [d // CYCLE for d in dues], [d % CYCLE for d in dues]
        self.whole_before = [0, *accumulate(self.whole)]
        self.part_before = [0, *accumulate(self.part)]

    def taken(self, t: int, k: int) -> int:
        """Tokens that queue k has given after t windows."""
        begin, f = self.part_before[k] % CYCLE, self.part[k]
        cycles, rest = divmod(t, CYCLE)
        extra = max(0, min(rest, begin + f) - begin) + max(0, min(rest, begin + f - CYCLE))
        return t * self.whole[k] + cycles * f + extra

    def window_of(self, offset: int, k: int) -> int:
        """The window, counted from first, that has the queue's token at this offset."""
        low = offset // (self.whole[k] * CYCLE + self.part[k]) * CYCLE
        high = low + CYCLE - 1
        while low < high:
            t = (low + high) // 2
            low, high = (low, t) if self.taken(t + 1, k) > offset else (t + 1, high)
        return low

    def place(self, t: int, k: int) -> int:
        """Where the queue's tokens begin in a window."""
        return self.whole_before[k] + (self.part_before[k] - t % CYCLE + CYCLE - 1) // CYCLE


def _dues(tokens: dict, weights: dict[str, float] | None) -> dict:
    return {q: max(1, round(weights.get(q, 0) * (1 << 20))) if weights else n for q, n in tokens.items()}


def schedule(tokens: dict[str, int], weights: dict[str, float] | None, size: int) -> dict[str, list[tuple]]:
    """For each queue its stretches, ascending: (from, to, phase, its number there) over many
    windows, or (from, to, window, place in it) within one.
    """
    left = {q: n for q, n in sorted(tokens.items()) if n}
    due = _dues(left, weights)
    given = dict.fromkeys(left, 0)
    stretches: dict[str, list[tuple]] = {q: [] for q in left}
    window = 0
    while left:
        names = list(left)
        phase = Phase(window, size, [due[q] for q in names])
        low, high = 0, max(left.values()) * len(names) // size + 2
        while low < high:  # the last window up to which no queue runs out
            t = (low + high + 1) // 2
            if all(phase.taken(t, k) <= left[q] for k, q in enumerate(names)):
                low = t
            else:
                high = t - 1
        for k, q in enumerate(names):
            if took := phase.taken(low, k):
                stretches[q].append((given[q], given[q] + took, phase, k))
                given[q] += took
                left[q] -= took
        window += low
        # One window in which queues run out: shares first, then what is left over, in turns.
        at, turn = 0, {q: phase.taken(low + 1, k) - phase.taken(low, k) for k, q in enumerate(names)}
        while at < size and any(left.values()):
            moved = False
            for q in names:
                took = min(turn[q], left[q], size - at)
                if took > 0:
                    stretches[q].append((given[q], given[q] + took, window, at))
                    given[q] += took
                    left[q] -= took
                    at += took
                    moved = True
            over = size - at
            open_ = [q for q in names if left[q]]
            total = sum(due[q] for q in open_)
            turn = dict.fromkeys(names, 0) | {q: over * due[q] // total for q in open_}
            if open_ and not any(turn.values()) or not moved:
                turn = dict.fromkeys(names, 0) | {q: 1 for q in open_}
        left = {q: n for q, n in left.items() if n}
        window += at == size
    return stretches


def _cuts(stretches: list[tuple], start: int, n: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(offset in the queue, length, window, place in it) of the parts of [start, start + n)."""
    low, high = 0, len(stretches) - 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if stretches[middle][0] <= start else (low, middle - 1)
    at, stop = start, start + n
    while at < stop:
        begin, end, where, k = stretches[low]
        if isinstance(where, Phase):
            t = where.window_of(at - begin, k)
            before = where.taken(t, k)
            took = min(stop, end, begin + where.taken(t + 1, k)) - at
            yield at, took, where.first + t, where.place(t, k) + at - begin - before
        else:
            took = min(stop, end) - at
            yield at, took, where, k + at - begin
        at += took
        low += at == end


def arrange(tokens: dict[str, int], weights: dict[str, float] | None, size: int) -> dict[str, tuple[tuple[list[tuple], int], ...]]:
    """For each queue the schedules that its tokens go through, innermost first: stretches, and size of a window.

    More queues than a window can be divided among fall into the larger ones and
    groups of the others; a group is scheduled as one queue, and within it its members.
    """
    left = {q: n for q, n in sorted(tokens.items()) if n}
    most = min(MOST_QUEUES, isqrt(size * CYCLE // 2))
    if len(left) <= most:
        return {q: ((parts, size),) for q, parts in schedule(left, weights, size).items()}
    due = _dues(left, weights)
    all_tokens, all_due = sum(left.values()), sum(due.values())
    ranked = sorted(left, key=lambda q: (-max(left[q] / all_tokens, due[q] / all_due), q))
    small_ones, shared = ranked[most // 2 :], most - most // 2
    groups = [small_ones[k::shared] for k in range(shared)]
    # Outer queues are numbered, as names of sources may be anything.
    members = [[q] for q in ranked[: most // 2]] + [g for g in groups if g]
    outer = {f"{k:06d}": sum(left[q] for q in g) for k, g in enumerate(members)}
    outer_due = {f"{k:06d}": sum(due[q] for q in g) for k, g in enumerate(members)}
    found = schedule(outer, {k: d / (1 << 20) for k, d in outer_due.items()} if weights else None, size)
    out = {}
    for k, g in zip(outer, members, strict=True):
        here = ((found[k], size),)
        if len(g) == 1:
            out[g[0]] = here
            continue
        inner = max(size * outer_due[k] // all_due, 2 * min(len(g), MOST_QUEUES) ** 2 // CYCLE + 1)
        out |= {q: path + here for q, path in arrange({q: left[q] for q in g}, weights, inner).items()}
    return out


def _places(path: tuple[tuple[list[tuple], int], ...], start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """As _cuts, through all schedules of a queue."""
    (stretches, size), *further = path
    for at, took, window, place in _cuts(stretches, start, n, size):
        if not further:
            yield at, took, window, place
            continue
        begin = window * size + place
        for spot, length, w, p in _places(further, begin, took):
            yield at + spot - begin, length, w, p


def _pieces(paths: dict[str, tuple], window: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in range(9)]
            for id_, queue, n, begin, ids in zip(*(batch.column(c).to_pylist() for c in ("id", "queue", "n", "begin", "ids")), strict=True):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                for at, took, w, place in _places(paths[queue], begin, n):
                    while took:
                        here = min(took, length - place % length)
                        start = at - begin
                        row = (id_, queue, start, here, wide[start : start + here].tobytes(), n, w, (w * window + place) // length, place % length)
                        for to, value in zip(out, row, strict=True):
                            to.append(value)
                        at, place, took = at + here, place + here, took - here
            i = pa.int64()
            types = (i, pa.string(), i, i, pa.binary(), i, i, i, i)
            names = ["id", "queue", "start", "length", "ids", "doc_tokens", "window", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    return run


def pack(
    docs: DataFrame,
    ranks_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length: int = 1024,
    window_sequences: int = 64,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Pack the tokens of documents into sequences of `length`.

    weights: target shares of sources; None takes each source's share of all
    tokens, so that every window mirrors the whole.  Sources without a weight
    fill in with a tiny one.  Returns one row per piece: id, queue (source),
    start and length in the document, ids (32-bit little-endian), doc_tokens,
    window, sequence_id, offset.

    A document's tokens end with id 0, so a null or empty text has one token.
    A null source is the queue ''.  Null and repeated ids are kept: every row
    is packed.  An empty table gives no pieces.  Other columns are ignored.
    """
    window = length * window_sequences
    source = own_columns(docs, id=id_col, text=text_col, queue=source_col).select("id", F.coalesce(F.col("queue").cast("string"), F.lit("")).alias("queue"), F.xxhash64("id", "text").alias("h"), "text")
    tokens = staged(source.mapInArrow(_tokenised(ranks_file, pattern), _TOKENS), "tokens")
    totals = tokens.groupBy("queue").agg(F.sum("n").alias("n"))
    sums = {r["queue"]: r["n"] for r in totals.collect()}
    buckets = 1 + sum(sums.values()) // BUCKET_TOKENS
    tokens = tokens.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tokens.groupBy("queue", "bucket").agg(F.sum("n").alias("m")).select("queue", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("queue", "bucket").orderBy("id", "n", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.select("id", "queue", "bucket", "n", "ids", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inside"))
    placed = placed.join(offsets, ["queue", "bucket"]).select("id", "queue", "n", (F.col("base") + F.col("inside")).alias("begin"), "ids")
    return placed.mapInArrow(_pieces(arrange(sums, weights, window), window, length), _PIECES)
