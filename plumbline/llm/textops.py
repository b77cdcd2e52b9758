"""Vectorised word spans and 64-bit hashes over Arrow text buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All functions work on the UTF-8 buffer of a
block of whole texts, so Python touches no single word. The hash of a span is a polynomial over a
random 64-bit value per byte, taken from one running sum (wrapping modulo 2**64), then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C17 & ~3 | 3
_WORD_BASE = 0xD6E8FEB86659FD93 & ~3 | 3
_SEGMENT = (1 << 17) - 64
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


if TaskContext.get() is not None:
    pa.set_memory_pool(pa.system_memory_pool())
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """In a Python worker, return freed memory to the system, where the C library can.

    Workers live on between tasks; what the allocator keeps for later counts against the executor.
    """
    if _trim is not None and TaskContext.get() is not None:
        _trim(0)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if base not in _pow or len(_pow[base][0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(base, -1, 2**64)
        up = np.full(size, base, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _pow[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _pow[base]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalise: every output bit depends on every input bit."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_blocks(batches: Iterable[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with at most ``max_bytes`` of text (one longer text stands alone): (rows, bytes, offsets).

    A null text counts as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max_bytes, "right")) - 1)
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b
            give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text with the total at its end) of all words in the block."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _SEGMENT, "right")))
        b = int(ends[j - 1])
        up, down = _powers(_BASE, b - a + 1)
        run = np.empty(b - a + 1, np.uint64)
        run[0] = 0
        np.cumsum(BYTE_VALUE[data[a:b]] * down[: b - a], dtype=np.uint64, out=run[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (run[e] - run[s]) * up[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive entries of ``words`` (len - width + 1 values, across texts)."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    out = np.empty(n - width + 1, np.uint64)
    for a in range(0, n - width + 1, _SEGMENT):
        b = min(n - width + 1, a + _SEGMENT)
        part = words[a : b + width - 1]
        up, down = _powers(_WORD_BASE, len(part) + 1)
        run = np.empty(len(part) + 1, np.uint64)
        run[0] = 0
        np.cumsum(part * down[: len(part)], dtype=np.uint64, out=run[1:])
        out[a:b] = (run[width:] - run[:-width]) * up[: b - a]
    return mix(out, width)
