"""Vectors as compact rows: validity, copies, and streams of groups over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """(id, vec, *more): rows with an id and a vector without null or non-finite components that isn't zero.

    Vectors are compared with those of their length only; a table's length is that of most usable rows (of the
    longer one, if two are as frequent), and rows of another length are left out like unusable ones.
    """
    v = F.col(vec_col)
    ok = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    out = vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *more)
    length = out.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return out.filter(F.size("vec") == (length["n"] if length else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column whose lists have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False))
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def blobs(column: pa.Array, dtype) -> np.ndarray:
    """A binary column whose values have one size, as rows of ``dtype``."""
    if not len(column):
        return np.zeros((0, 0), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(column), -1)


def binary_rows(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1) if len(values) else np.zeros((0, 0), np.uint8)
    size = raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * size, size, dtype=np.int32) if size else np.zeros(len(raw) + 1, np.int32)), pa.py_buffer(raw.tobytes())])


def ragged(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as (all values, where each row begins with the total last)."""
    size = np.dtype(dtype).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype) if column.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype)
    return data, (offsets - offsets[0]) // size


def by_groups(batches: Iterable[pa.RecordBatch], key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], most: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Call ``work`` on tables of whole groups of a stream sorted by ``key``."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy()
        last = int(np.searchsorted(k, k[-1], "left"))
        if last == 0 and rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1].as_py() == k[-1]:
            rest.append(batch)
            continue
        if rest or last:
            yield from work(pa.Table.from_batches([*rest, batch.slice(0, last)]))
        rest = [batch.slice(last)]
    if rest:
        yield from work(pa.Table.from_batches(rest))
