"""Truncated SVD of a distributed sparse matrix by randomised subspace iteration.

The matrix X has a row for each document: `idx` (columns, ascending) and `val`. What is iterated is an orthonormal basis Q of
`rank + oversample` directions in column space. A pass multiplies X'(XQ): each task multiplies blocks of its own sparse
rows and adds up one columns-by-directions matrix; these are summed by slices of columns in two levels, and the driver gets
the sum, orthonormalises it, and sends it out again. No matrix of columns by columns is made, and rows never move. What is sent and
collected is width x (rank + oversample) numbers, at most 20,000 x 110 as used here (17.6 MB), whatever the rows are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the matrix that are multiplied together: bounds a task's memory to as many rows of Q.
ENTRIES = 1 << 14
#: Cells of a block's own columns up to which it is multiplied as a dense matrix.
CELLS = 1 << 21
SLICES = 32
_DDL = "slice int, salt int, part binary"


def _row_blocks(batch: pa.RecordBatch):
    """(columns, values, row of each entry, number of rows) for runs of rows of about ENTRIES entries; the last two columns are idx and val."""
    idx, val = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    sizes = idx.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    columns, values = idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < len(sizes):
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + ENTRIES, "right")) - 1)
        a, b = upto[first], upto[end]
        yield columns[a:b], values[a:b], np.repeat(np.arange(end - first), sizes[first:end]), end - first
        first = end


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows with the same key, and the keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(rows[order], starts, axis=0)


def _packed(columns, values, row, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The columns that a block of rows has, and the block over these alone; None where that would be large."""
    of, at = np.unique(columns, return_inverse=True)
    if n * len(of) > CELLS:
        return None
    return of, np.bincount(row * len(of) + at, values, n * len(of)).reshape(n, len(of))


def _gram(columns, values, row, n: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns, and their rows of X'(Xq) for a block X."""
    packed = _packed(columns, values, row, n)
    if packed is None:
        return _summed(columns, values[:, None] * _times(columns, values, row, n, q)[row])
    of, x = packed
    return of, x.T @ (x @ q[of])


def _times(columns, values, row, n: int, q: np.ndarray) -> np.ndarray:
    """A block of rows times q."""
    out = np.zeros((n, q.shape[1]))
    if len(columns):
        of, sums = _summed(row, values[:, None] * q[columns])
        out[of] = sums
    return out


def gram_times(vectors: DataFrame, q: np.ndarray) -> np.ndarray:
    """X'(Xq), for vectors with the columns idx and val."""
    width, k = q.shape
    sent = vectors.sparkSession.sparkContext.broadcast(q)
    cuts = np.linspace(0, width, SLICES + 1).astype(int)

    def multiply(batches):
        held, q = np.zeros((width, k)), sent.value
        for batch in batches:
            for columns, values, row, n in _row_blocks(batch):
                if len(columns):
                    of, sums = _gram(columns, values, row, n, q)
                    held[of] += sums
        salt = int.from_bytes(np.random.default_rng().bytes(2))  # which partial sums meet first does not matter
        for i in range(SLICES):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([salt % 16], pa.int32()), pa.array([held[cuts[i] : cuts[i + 1]].tobytes()])], ["slice", "salt", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for part in table.column("part").to_pylist():
            x = np.frombuffer(part)
            total = x.copy() if total is None else total + x
        return pa.table({"slice": table.column("slice")[:1], "salt": table.column("salt")[:1], "part": pa.array([total.tobytes()])})

    parts = vectors.select("idx", "val").mapInArrow(multiply, _DDL)
    sums = parts.groupBy("slice", "salt").applyInArrow(add, _DDL).groupBy("slice").applyInArrow(add, _DDL).collect()
    sent.unpersist()
    out = np.zeros((width, k))
    for r in sums:
        out[cuts[r.slice] : cuts[r.slice + 1]] = np.frombuffer(bytes(r.part)).reshape(-1, k)
    return out


def fit(vectors: DataFrame, width: int, rank: int, passes: int = 6, oversample: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The first right singular vectors (width x rank) and singular values of the rows (idx, val)."""
    k = min(rank + oversample, width)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, k)))[0]
    for _ in range(passes):
        q = np.linalg.qr(gram_times(vectors, q))[0]
    small = q.T @ gram_times(vectors, q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:rank]
    v = q @ turn[:, best]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)  # the largest entry is positive
    return v, np.sqrt(np.maximum(values[best], 0))


def project(vectors: DataFrame, v: np.ndarray, key: str) -> DataFrame:
    """key and `reduced`, each row times v."""
    sent = vectors.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        for batch in batches:
            rows = [_times(*block, sent.value) for block in _row_blocks(batch)]
            flat = np.concatenate(rows) if rows else np.zeros((0, v.shape[1]))
            offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * v.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], ["key", "reduced"])

    kind = vectors.schema[key].dataType.simpleString()
    out = vectors.select(F.col(key).alias("key"), "idx", "val").mapInArrow(run, f"key {kind}, reduced array<double>")
    return out.withColumnRenamed("key", key)
