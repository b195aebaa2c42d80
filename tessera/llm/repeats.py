"""Suffix-array dedup: removal of every byte that lies in a string of `length`
bytes that also starts elsewhere.

All suffixes of a large corpus are never held in one place.  Every string of
`length` bytes contains one chosen gram (the rightmost least hash of its grams
of about a third of that length), the same one wherever the string occurs.  So

1. texts are scanned for chosen grams; each yields its hash, a hash of its
   context (all bytes that a string around it can reach) and hashes of the
   context's halves;
2. a gram that occurs once has no repeated string around it; where a context
   occurs again, all strings in it are repeated.  Two grouped counts settle
   these;
3. the other contexts, one of each kind and only those that agree in a half
   with another one, are brought together by gram and half.  A suffix array,
   built by linear grouping over their byte blocks, finds the suffixes that
   agree for as many blocks as a string of `length` bytes must hold; the byte
   offsets within these blocks are then settled exactly.  A group with more
   contexts than a task should hold is settled without being gathered, by
   counts of its strings' hashes at each offset;
4. the spans found go back to the texts, which are cut.

Hashes have 64 bits; agreeing strings always agree in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import BROADCAST_KEYS, discard, only, own_columns, staged
from tessera.llm._text import _BYTE, U, mix, piece_hashes, slices, small
from tessera.llm.suffix_groups import suffix_array

#: Contexts whose suffixes are sorted together, if no single group has more.
CONTEXTS_AT_ONCE = 2000
#: Contexts of a group that is gathered, at most.
LARGEST_GROUP = 30_000
_PLACE_BITS = 28
_ODD = U(0xA0761D6478BD642F)


def gram_size(length: int) -> int:
    """The largest power of two up to a third of the length."""
    size = 1
    while size * 2 * 3 <= length:
        size *= 2
    return size


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each gram, by doubling."""
    out, have, factor = _BYTE[data], 1, 0x9E3779B97F4A7C15
    while have < size:
        out = out[:-have] * U(factor) + out[have:]
        out = out ^ (out >> U(31))
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        have *= 2
    return mix(out)


def chosen(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of hashes, the place of its rightmost least one."""
    places = np.arange(len(hashes), dtype=U)
    low = U((1 << _PLACE_BITS) - 1)
    least = (hashes & ~low) | (low - places)
    done = 1
    while done * 2 <= window:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < window:
        least = np.minimum(least[: len(hashes) - window + 1], least[window - done :])
    return (low - (least & low)).astype(np.int64)


def _anchors(length: int):
    size = gram_size(length)
    side = length - size
    half = side // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, _, data, offsets in slices(batch.column(1)):
                if len(data) < length:
                    continue
                text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                hashes = _grams(data, size)
                at = chosen(hashes, side + 1)
                at = at[text_of[: len(at)] == text_of[length - 1 : length - 1 + len(at)]]
                if not len(at):
                    continue
                at = at[np.append(True, at[1:] != at[:-1])]
                own = text_of[at]
                left = np.minimum(at - offsets[own], side)
                right = np.minimum(offsets[own + 1] - at - size, side)
                context = piece_hashes(data, at - left, at + size + right)
                low, high = np.maximum(at - half, 0), np.minimum(at + size + half, len(data))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(first + own)),
                        pa.array((at - offsets[own]).astype(np.int32)),
                        pa.array(left.astype(np.int32)),
                        pa.array(right.astype(np.int32)),
                        pa.array(hashes[at].view(np.int64)),
                        pa.array(context.view(np.int64)),
                        pa.array((piece_hashes(data, low, at) >> U(33)).astype(np.int32)),
                        pa.array((piece_hashes(data, at + size, high) >> U(33)).astype(np.int32)),
                    ],
                    names=["key", "at", "left", "right", "gram", "context", "before", "after"],
                )

    return run


_ANCHORS = "key long, at int, left int, right int, gram long, context long, before int, after int"
#: What a kind of context carries along: itself, how often it occurs, and where it does first.
_KIND = "gram long, context long, n long, key long, at int"
_CONTEXTS = f"group long, {_KIND}, upper boolean, lefts binary, rights binary"
_FOUND = f"{_KIND}, low int, high int"
_STRINGS = f"{_KIND}, d int, string long"
_KIND_NAMES = ("gram", "context", "n", "key", "at")
_KIND_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())


def _wanted(batches: Iterator[pa.RecordBatch], size: int, half: int) -> Iterator[tuple[dict, bytes, bytes]]:
    """The wanted contexts of each text, with their bytes before and behind the gram."""
    for batch in small(batches):
        for text, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("wanted"), strict=True):
            text = text.as_py()
            for w in wanted.as_py():
                a, b = w["at"], w["at"] + size
                left, right = (w["left"], min(w["right"], half)) if w["upper"] else (min(w["left"], half), w["right"])
                yield w, text[a - left : a], text[b : b + right]


def _contexts(length: int):
    """The bytes of the wanted contexts of each text: side by side of the gram."""
    size = gram_size(length)
    half = (length - size) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _wanted(batches, size, half)
        while part := list(islice(rows, CONTEXTS_AT_ONCE)):
            kinds = [pa.array([w[c] for w, _, _ in part], t) for c, t in zip(_KIND_NAMES, _KIND_TYPES, strict=True)]
            sides = [pa.array([x[k] for x in part], pa.binary()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([w["group"] for w, _, _ in part], pa.int64()), *kinds, pa.array([w["upper"] for w, _, _ in part], pa.bool_()), *sides], names=["group", *_KIND_NAMES, "upper", "lefts", "rights"])

    return run


def _strings(length: int):
    """A hash of every string of `length` bytes around the grams of the wanted contexts."""
    size = gram_size(length)
    side = length - size
    half = side // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _wanted(batches, size, half)
        while part := list(islice(rows, CONTEXTS_AT_ONCE // 20)):
            of, ds, hashes = [], [], []
            for k, (w, left, right) in enumerate(part):
                low, high = max(half + 1 if w["upper"] else 0, side - len(right)), min(side if w["upper"] else half, len(left))
                if high >= low:
                    data = np.frombuffer(left + right, dtype=np.uint8)
                    d = np.arange(low, high + 1)
                    of.append(np.full(len(d), k))
                    ds.append(d)
                    hashes.append(piece_hashes(data, len(left) - d, len(left) - d + side))
            at = np.concatenate(of) if of else np.zeros(0, np.int64)
            kinds = [pa.array([w[c] for w, _, _ in part], t).take(pa.array(at)) for c, t in zip(_KIND_NAMES, _KIND_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*kinds, pa.array(np.concatenate(ds) if ds else at, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64) if hashes else at)], names=[*_KIND_NAMES, "d", "string"])

    return run


def repeated_offsets(groups: np.ndarray, upper: np.ndarray, lefts: list[bytes], rights: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of bytes before the gram with which a string
    of one context equals one of another context of its group; -1 if there is
    none.  Contexts of a group must differ.
    """
    n = len(groups)
    half = side // 2
    block = max(1, side // 8)
    left, right = np.zeros((n, side), dtype=np.uint8), np.zeros((n, side), dtype=np.uint8)
    n_left, n_right = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    for k in range(n):
        left[k, : n_left[k]] = np.frombuffer(lefts[k], dtype=np.uint8)[::-1]
        right[k, : n_right[k]] = np.frombuffer(rights[k], dtype=np.uint8)

    def running(sides: np.ndarray) -> np.ndarray:
        out = np.zeros((n, side + 1), dtype=U)
        for j in range(side):
            out[:, j + 1] = (out[:, j] ^ (out[:, j] >> U(29))) * _ODD + _BYTE[sides[:, j]]
        return out

    before, after = running(left), running(right)

    # Blocks as symbols: those before the gram, far to near; the group; those behind it.
    many = side // block
    symbols, of, steps = [], [], []
    for sides, running_, have, sign in ((left, before, n_left, -1), (right, after, n_right, 1)):
        for b in range(many):
            rows = np.flatnonzero(have >= (b + 1) * block)
            own = np.zeros(len(rows), dtype=U)
            for j in range(b * block, (b + 1) * block):
                own = (own ^ (own >> U(29))) * _ODD + _BYTE[sides[rows, j]]
            symbols.append(mix(own + U(b if sign < 0 else b + many)))
            of.append(rows)
            steps.append(np.full(len(rows), sign * (b + 1)))
    symbols += [mix(groups.view(U)), np.zeros(n, dtype=U)]
    of += [np.arange(n), np.arange(n)]
    steps += [np.zeros(n, dtype=np.int64), np.full(n, many + 1)]
    symbols, of, steps = np.concatenate(symbols), np.concatenate(of), np.concatenate(steps)
    order = np.lexsort((steps, of))
    symbols, of, steps = symbols[order], of[order], steps[order]
    ends = steps == many + 1
    ranks = np.unique(symbols, return_inverse=True)[1] + 1
    ranks[ends] = 1
    ranks[~ends] += 1
    found = np.array(suffix_array(ranks.tolist()), dtype=np.int64)

    # Neighbours in the suffix array that agree in as many blocks as a string must hold.
    must = many
    wide = np.concatenate([ranks, np.ones(must, dtype=ranks.dtype)])
    same = np.ones(len(found) - 1, dtype=bool)
    for j in range(must):
        here = wide[found + j]
        same &= (here[1:] == here[:-1]) & (here[1:] != 1)
    runs = np.concatenate([[0], np.cumsum(~same)])
    sizes = np.bincount(runs)
    kept = (sizes[runs] > 1) & (steps[found] <= 0)
    runs, found = runs[kept], found[kept]
    if not len(found):
        return np.full(n, -1), np.full(n, -1)

    # Exact offsets within the blocks.
    context, reach = of[found], -steps[found]
    d = (reach * block)[:, None] + np.arange(block)[None, :]
    rows = np.broadcast_to(context[:, None], d.shape)
    mine = np.where(upper[rows], d > half, d <= half)
    mine &= (d <= n_left[rows]) & (side - d <= n_right[rows]) & (d <= side)
    rows, d, runs = rows[mine], d[mine], np.broadcast_to(runs[:, None], mine.shape)[mine]
    keys = mix(mix(before[rows, d] + U(7) * after[rows, side - d]) + mix(groups[rows].view(U) + d.astype(U)) + U(2) * upper[rows].astype(U))
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    rows, d = rows[again], d[again]
    low, high = np.full(n, side + 1), np.full(n, -1)
    np.minimum.at(low, rows, d)
    np.maximum.at(high, rows, d)
    low[high < 0] = -1
    return low, high


def _solved(length: int):
    side = length - gram_size(length)

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        low, high = repeated_offsets(
            rows["group"].to_numpy(), rows["upper"].to_numpy(), rows["lefts"].to_pylist(), rows["rights"].to_pylist(), side
        )
        good = high >= 0
        kinds = [pa.array(rows[c].to_numpy()[good]) for c in _KIND_NAMES]
        return pa.RecordBatch.from_arrays([*kinds, pa.array(low[good].astype(np.int32)), pa.array(high[good].astype(np.int32))], names=[*_KIND_NAMES, "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by group; whole groups are solved together.
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, CONTEXTS_AT_ONCE):
                piece = batch.slice(at, CONTEXTS_AT_ONCE)
                groups = piece.column("group").to_numpy()
                cut = int(np.searchsorted(groups, groups[-1], side="left"))
                if count and cut == 0 and held[-1].column("group")[-1].as_py() != groups[0]:
                    yield solve(held)
                    held, count = [], 0
                if cut and count + cut >= CONTEXTS_AT_ONCE:
                    yield solve([*held, piece.slice(0, cut)])
                    held, count = [], 0
                    piece = piece.slice(cut)
                held.append(piece)
                count += piece.num_rows
        if held:
            yield solve(held)

    return run


_CUT = "id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _cut(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[], [], [], [], [], []]
            for text, starts, stops in zip(batch.column("text").cast(pa.binary()), batch.column("starts"), batch.column("stops"), strict=True):
                text = text.as_py() or b""
                merged: list[int] = []
                for a, b in sorted(zip(starts.as_py() or (), stops.as_py() or (), strict=True)):
                    if merged and a <= merged[-1]:
                        merged[-1] = max(merged[-1], b)
                    else:
                        merged += [a, b]
                pairs = [(a, b) for a, b in zip(merged[::2], merged[1::2], strict=True) if not least_words or len(text[a:b].split()) >= least_words]
                kept, at = [], 0
                for a, b in pairs:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                for to, value in zip(out, (rest.decode("utf-8", "ignore"), len(text), len(text) - len(rest), len(pairs), hashlib.sha256(rest).hexdigest(), [x for p in pairs for x in p]), strict=True):
                    to.append(value)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            columns = [batch.column("id").cast(pa.int64()), *(pa.array(x, t) for x, t in zip(out, types, strict=True))]
            names = ["id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            if "carry" in batch.schema.names:
                columns, names = [*columns, batch.column("carry")], [*names, "carry"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, carry: list[str] | None = None, least_words: int = 0) -> DataFrame:
    """Cut every byte covered by a `length`-byte string that also starts elsewhere.

    Returns one row per input row: id, text (what is left; a character that
    was cut in two is dropped), n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 (of the remaining bytes), spans (byte ranges, flat).

    With carry, these columns of the input come back in a struct of that name.
    With least_words, maximal runs of fewer words stay.

    Strings are judged on the input and never cross texts.  A null text is
    empty.  Texts shorter than `length` stay whole.  Of repeated texts every
    one is cut, rows that repeat id and text included.  Null ids are kept.
    Other columns of the input are ignored.
    """
    size = gram_size(length)
    side = length - size
    half = side // 2
    source = own_columns(docs, id=id_col, text=text_col).withColumn("key", F.xxhash64("id", "text"))
    anchors = staged(source.where(F.octet_length("text") >= length).select("key", "text").mapInArrow(_anchors(length), _ANCHORS), "anchors")

    seen = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).where("n > 1").select("gram", (F.col("a") == F.col("b")).alias("agree"))
    seen = staged(seen, "seen")
    again = staged(anchors.join(seen, "gram"), "again")
    discard(anchors, seen)
    # How often its context occurs goes to every occurrence.  Written first: next to a grouping, Spark could not split a very common context in the join.
    counts = staged(again.groupBy("gram", "context").agg(F.count("*").alias("n")), "counts")
    placed = staged(again.join(counts, ["gram", "context"]), "placed")
    discard(again, counts)
    columns = ("gram", "context", "n", "key", "at", "left", "right", "before", "after")
    several = placed.where("not agree and n > 1").groupBy("gram", "context").agg(F.min(F.struct(*columns[2:])).alias("r")).select("gram", "context", "r.*")
    kinds = staged(placed.where("not agree and n = 1").select(*columns).unionByName(several), "kinds")
    # A string with up to half of the side before the gram needs the half behind it; one with more, the half before it.
    halves = kinds.select(
        *_KIND_NAMES, "left", "right",
        F.explode(F.array(
            F.when(F.col("right") >= half, F.struct(F.lit(False).alias("upper"), F.col("after").alias("half"))),
            F.when(F.col("left") >= half, F.struct(F.lit(True).alias("upper"), F.col("before").alias("half"))),
        )).alias("h"),
    ).where("h is not null").select("*", "h.upper", F.xxhash64("gram", "h.upper", "h.half").alias("group"))
    shared = staged(halves.groupBy("group").agg(F.count("*").alias("m")).where("m > 1"), "shared")

    def fetched(groups: DataFrame) -> DataFrame:
        """Texts with the contexts of these groups that are wanted of them."""
        wanted = halves.join(groups.select("group"), "group").withColumn("of", F.col("key")).groupBy("of").agg(F.collect_list(F.struct("group", *_KIND_NAMES, "upper", "left", "right")).alias("wanted"))
        wanted = staged(wanted.withColumnRenamed("of", "key"), "wanted")
        return only(source.select("key", "text"), wanted.select("key"), "key").join(wanted, "key")

    contexts = fetched(shared.where(f"m <= {LARGEST_GROUP}")).mapInArrow(_contexts(length), _CONTEXTS)
    # Rows that repeat id and text bring the same contexts.
    contexts = contexts.repartition("group").dropDuplicates(["group", "context"]).sortWithinPartitions("group")
    solved = staged(contexts.mapInArrow(_solved(length), _FOUND), "solved")
    large = shared.where(f"m > {LARGEST_GROUP}")
    if not large.isEmpty():
        strings = staged(fetched(large).mapInArrow(_strings(length), _STRINGS), "strings")
        twice = staged(strings.groupBy("gram", "d", "string").agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a <> b").select("gram", "d", "string"), "twice")
        solved = solved.union(strings.join(twice, ["gram", "d", "string"]).groupBy(*_KIND_NAMES).agg(F.min("d").alias("low"), F.max("d").alias("high")))

    # Of a context that occurs again, all strings do; of one that occurs once, those that were found.
    spans = placed.where("n > 1").select("key", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + size + F.col("right")).alias("stop"))
    spans = spans.union(solved.where("n = 1").select("key", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("stop")))
    spans = staged(spans.distinct().groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")), "spans")
    discard(placed, kinds, shared)
    if carry:
        source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carry")).withColumn("key", F.xxhash64("id", "text"))
    schema = _CUT + (f", carry {source.schema['carry'].dataType.simpleString()}" if carry else "")
    few = (spans.agg(F.sum(F.size("starts") + 1)).first()[0] or 0) <= BROADCAST_KEYS
    return source.join(F.broadcast(spans) if few else spans, "key", "left").mapInArrow(_cut(least_words), schema)
