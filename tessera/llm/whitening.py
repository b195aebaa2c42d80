"""Whitening of embeddings by a two-pass covariance.

Components become integers, so that the first pass' sums and every vector's
squared deviation are exact whatever the order of adding.  The second pass
subtracts the mean and sums outer products, one matrix product per Arrow
batch.  Partial results of tasks, a vector or a square matrix as wide as an
embedding, are merged by a tree of executors; LAPACK's symmetric solver gives
the components, and a broadcast matrix projects every vector on them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._tables import own_columns

#: Integers are kept within this size, so that sums over a batch stay exact in 64 bits.
_LARGEST = 1 << 40
#: Share of the total variance below which a component has none.
_NOTHING = 1e-12


def _usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) of the usable vectors of a list column, one matrix for each width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    widths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        matrix = values[offsets[rows][:, None] + np.arange(width)]
        whole = np.isfinite(matrix).all(axis=1)
        if whole.any():
            yield rows[whole], matrix[whole]


def _integers(matrix: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.clip(np.floor(scale * matrix), -_LARGEST, _LARGEST).astype(np.int64) + shift


def _merged(vectors: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """What `partial` makes of each task's batches, merged by a tree; None where there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(partial(batches))], pa.binary())], names=["state"])

    either = lambda a, b: a if b is None else b if a is None else merge(a, b)
    states = vectors.mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(bytes(r["state"])))
    return states.treeAggregate(None, either, either, depth=2)


def _sums(scale: int, shift: int):
    """By width: number of vectors and the exact sums of their integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[int, list[int]]]:
        out: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for _, matrix in _usable(batch.column("vector")):
                own = {matrix.shape[1]: (len(matrix), [int(x) for x in _integers(matrix, scale, shift).sum(axis=0)])}
                out = _added(out, own)
        return out

    return run


def _added(a: dict, b: dict) -> dict:
    out = dict(a)
    for width, (n, sums) in b.items():
        m, have = out.get(width, (0, [0] * width))
        out[width] = (m + n, [x + y for x, y in zip(have, sums, strict=True)])
    return out


def _products(scale: int, shift: int, mean: np.ndarray):
    """Sum of outer products of the centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = np.zeros((len(mean), len(mean)))
        for batch in batches:
            for _, matrix in _usable(batch.column("vector")):
                if matrix.shape[1] == len(mean):
                    centred = _integers(matrix, scale, shift) - mean
                    out += centred.T @ centred
        return out

    return run


@dataclass
class Whitening:
    """The fitted map: x = floor(scale c) + shift is centred, projected and divided by standard deviations."""

    n: int
    sums: list[int]
    scale: int
    shift: int
    #: Unit eigenvectors as columns, with their eigenvalues and shares of the variance.
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN on components without variance."""
        flat = self.values <= 0
        out = (x - self.mean) @ self.axes / np.sqrt(np.where(flat, 1, self.values))
        out[:, flat] = np.nan
        return out

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S) squared, exact; None where a long cannot hold it."""
        rough = self.n * (x - self.mean)
        size = (rough**2).sum(axis=1)
        if size.max(initial=0) < 4e18 and self.n * float(np.abs(x).max(initial=0)) < 4e18 and max(map(abs, self.sums)) < 4e18:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]


def _moments(model: Whitening):
    """Number, mean and centred products of the whitened vectors, batches merged by their means."""

    def run(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        out = None
        for batch in batches:
            for _, matrix in _usable(batch.column("vector")):
                if matrix.shape[1] == len(model.sums):
                    w = model.whitened(_integers(matrix, model.scale, model.shift))[:, model.values > 0]
                    mean = w.mean(axis=0)
                    own = (len(w), mean, (w - mean).T @ (w - mean))
                    out = own if out is None else _pooled(out, own)
        return out

    return run


def _pooled(a: tuple, b: tuple) -> tuple:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def fit(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors of a table; None if there are none.

    Three passes: sums; centred products; and the covariance of what comes
    out, as a check.  Usable is a vector without null or non-finite entries.
    Where widths differ, the width that most usable vectors have is fitted
    (of ties, the smaller).
    """
    source = own_columns(vectors, vector=vector_col)
    sums = _merged(source, _sums(scale, shift), _added)
    if not sums:
        return None
    width, (n, total) = min(sums.items(), key=lambda x: (-x[1][0], x[0]))
    mean = np.array([s / n for s in total])
    covariance = _merged(source, _products(scale, shift, mean), np.add) / n
    values, axes = np.linalg.eigh(covariance)
    best = np.argsort(-values, kind="stable")[: min(components, width)]
    values, axes, trace = values[best], axes[:, best], float(np.trace(covariance))
    # Either sign is right: the largest entry is made positive, so that runs agree.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(best))])
    values = np.where(values > _NOTHING * trace, values, 0.0)
    model = Whitening(n, total, scale, shift, axes, values, values / trace if trace > 0 else np.zeros(len(values)))
    if (values > 0).any():
        n, _, products = _merged(source, _moments(model), _pooled)
        model.identity_error = float(np.abs(products / n - np.eye(len(products))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, deviation, whitened of every usable vector of the fitted width.

    Dropped are rows whose vector is null, empty, of another width, or holds a
    null or non-finite entry; rows that repeat an id or a vector and null ids
    stay.  `deviation` is null where a long cannot hold it, an entry of
    `whitened` where its component has no variance (all vectors alike, or
    fewer of them than components).  Entries beyond 2**40 in size after
    scaling count as that.  Without a model (no usable vector) there are no
    rows.  Other columns are ignored.
    """
    source = own_columns(vectors, id=id_col, vector=vector_col)
    schema = f"id {source.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>"
    if model is None:
        return source.sparkSession.createDataFrame([], schema)
    given = source.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given.value
        for batch in batches:
            for rows, matrix in _usable(batch.column("vector")):
                if matrix.shape[1] == len(own.sums):
                    x = _integers(matrix, own.scale, own.shift)
                    w = own.whitened(x)
                    flat = pa.array(w.ravel(), from_pandas=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(own.deviations(x), pa.int64()), lists], names=["id", "deviation", "whitened"])

    return source.mapInArrow(run, schema)
