"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are windows of `window` consecutive words of the benchmark items (an
item of fewer words is one shorter window).  Patterns of one length share a
block shift table: for every block of two words it holds how far the window's
end can move on before a pattern could end there.  The search looks at a
block, and moves on by its shift without looking at what lies between; where
the shift is zero, the block's hash selects a bucket of patterns, and the
words themselves are compared.  Many stretches of text move on side by side.

Patterns are handled in blocks of a bounded number.  The driver holds one
block's tables at a time; the documents are never shuffled.  What further
blocks find is written, and joins the documents by a hash of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._tables import discard, own_columns, staged
from tessera.llm._text import ALNUM, U, Words, combined, slices

#: Different windows whose tables are held by the driver and sent to the tasks at once.
BLOCK_WINDOWS = 100_000
#: Words of a stretch, in which the search moves on by itself.
_STRETCH = 256
_CELLS = 1 << 20

_WINDOWS = T.StructType([T.StructField("item", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
_FOUND = "id long, n_words long, n_hit long, items array<string>, spans array<long>"


def _joined(words: Words, first: int, last: int) -> bytes:
    return b" ".join(words.bytes[words.starts[k] : words.ends[k]].tobytes() for k in range(first, last))


def _windows(window: int):
    """The distinct windows of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes, texts, hashes = [], [], [], []
            names = batch.column(0).to_pylist()
            for first, last, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                all_hashes = words.hashes().view(np.int64)
                for k in range(last - first):
                    a, b = int(words.of[k]), int(words.of[k + 1])
                    seen = set()
                    for s in range(a, max(b - window, a) + 1) if b > a else ():
                        e = min(s + window, b)
                        if (text := _joined(words, s, e)) not in seen:
                            seen.add(text)
                            items.append(names[first + k])
                            sizes.append(e - s)
                            texts.append(text)
                            hashes.append(all_hashes[s:e].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=["item", "n", "words", "hashes"])

    return run


class _Table:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, n: int, rows: list) -> None:
        self.n, self.block = n, min(2, n)
        words = np.array([r["hashes"] for r in rows], dtype=np.int64).view(U)
        self.shift = np.full(_CELLS, n - self.block + 1, dtype=np.uint8)
        for end in range(self.block - 1, n):
            cells = self.cells(self.blocks(words[:, end - self.block + 1 : end + 1]))
            self.shift[cells] = np.minimum(self.shift[cells], n - 1 - end)
        last = self.blocks(words[:, n - self.block :])
        self.suffixes = np.unique(last)
        self.buckets: dict[int, dict[bytes, list[str]]] = {}
        for row, key in zip(rows, last.tolist(), strict=True):
            self.buckets.setdefault(key, {})[bytes(row["words"])] = row["items"]

    @staticmethod
    def blocks(words: np.ndarray) -> np.ndarray:
        n = words.shape[1]
        return combined(words.reshape(-1), n)[::n]

    @staticmethod
    def cells(blocks: np.ndarray) -> np.ndarray:
        return (blocks & U(_CELLS - 1)).astype(np.int64)

    def ends(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words at which a pattern may end, ascending, and the hashes of the blocks there."""
        last = len(hashes) - self.block + 1
        at = np.arange(0, max(last, 0), _STRETCH)
        stop = np.minimum(at + _STRETCH, last)
        found, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U)]
        while len(at):
            blocks = self.blocks(np.stack([hashes[at + k] for k in range(self.block)], axis=1))
            shift = self.shift[self.cells(blocks)]
            here = np.flatnonzero(shift == 0)
            if len(here):
                near = np.searchsorted(self.suffixes, blocks[here])
                here = here[self.suffixes[np.minimum(near, len(self.suffixes) - 1)] == blocks[here]]
                found.append(at[here])
                keys.append(blocks[here])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends, blocks = np.concatenate(found), np.concatenate(keys)
        order = np.argsort(ends)
        return ends[order] + self.block - 1, blocks[order]


def _merged(spans: list[int]) -> list[int]:
    """Overlapping and touching ranges of a flat list made one."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _search(tables: list[_Table], hits_only: bool):
    """The ranges and items found in each text; with hits_only, of the texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n_words = np.zeros(rows, dtype=np.int64)
            spans: list[list[int]] = [[] for _ in range(rows)]
            items: list[list[str]] = [[] for _ in range(rows)]
            for first, last, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, ALNUM)
                n_words[first:last] = np.diff(words.of)
                hashes = words.hashes()
                for table in tables:
                    ends, blocks = table.ends(hashes)
                    of = np.searchsorted(words.of, ends, side="right") - 1
                    whole = ends - (table.n - 1) >= words.of[of]
                    for end, block, k in zip(ends[whole].tolist(), blocks[whole].tolist(), of[whole].tolist(), strict=True):
                        if got := table.buckets[block].get(_joined(words, end - table.n + 1, end + 1)):
                            at = int(words.of[k])
                            spans[first + k] += [end - table.n + 1 - at, end + 1 - at]
                            items[first + k] += got
            spans = [_merged(x) for x in spans]
            yield from _rows(batch.column(0), n_words, spans, [sorted(set(x)) for x in items], np.array([bool(x) for x in spans], dtype=bool) if hits_only else None)

    return run


def _rows(ids: pa.Array, n_words: np.ndarray, spans: list[list[int]], items: list[list[str]], kept: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    n_hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
    columns = [ids.cast(pa.int64()), pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_hit", "items", "spans"])
    yield batch if kept is None else batch.filter(pa.array(kept))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What all blocks found in each text, and its words."""
    for batch in batches:
        n_words = np.zeros(batch.num_rows, dtype=np.int64)
        for first, last, data, offsets in slices(batch.column("text")):
            n_words[first:last] = np.diff(Words(data, offsets, ALNUM).of)
        spans = [_merged([x for part in parts or () for x in part]) for parts in batch.column("spans").to_pylist()]
        items = [sorted({x for part in parts or () for x in part}) for parts in batch.column("items").to_pylist()]
        yield from _rows(batch.column("id"), n_words, spans, items, None)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Words of documents that lie in a window of a benchmark item.

    Returns one row per input row: id, n_words, n_hit (words inside any
    occurrence), items (sorted ids, as strings, of the items with occurring
    windows), spans (word ranges [start, end), flat).

    Words are runs of ASCII letters, digits and all characters from U+0080 on,
    A-Z lower-cased.  A null or empty text has no words.  Items without words,
    text or id are ignored; repeated items are listed once.  An empty benchmark
    hits nothing.  Other columns of both tables are ignored.
    """
    items = own_columns(benchmark, item=item_col, text=item_text).where("item is not null").select(F.col("item").cast("string").alias("item"), "text")
    source = own_columns(docs, id=id_col, text=text_col)
    # Rows of an item that is repeated, and windows of several items, are one pattern.
    windows = items.mapInArrow(_windows(window), _WINDOWS).groupBy("n", "words").agg(F.first("hashes").alias("hashes"), F.sort_array(F.collect_set("item")).alias("items"))
    windows = staged(windows, "windows")
    blocks = 1 + windows.count() // BLOCK_WINDOWS
    part = lambda k: _tables(windows.where(F.pmod(F.xxhash64("n", "words"), F.lit(blocks)) == k).collect())
    if blocks == 1:
        return source.mapInArrow(_search(part(0), False), _FOUND)
    keyed = source.select(F.xxhash64("id", "text").alias("key"), "id", "text")
    hits = [staged(keyed.select("key", "text").mapInArrow(_search(part(k), True), _FOUND).select(F.col("id").alias("key"), "items", "spans").distinct(), "hits") for k in range(blocks)]
    discard(windows)
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    every = every.groupBy("key").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))
    return keyed.join(every, "key", "left").select("id", "text", "items", "spans").mapInArrow(_gathered, _FOUND)


def _tables(rows: list) -> list[_Table]:
    return [_Table(n, [r for r in rows if r["n"] == n]) for n in sorted({r["n"] for r in rows})]
