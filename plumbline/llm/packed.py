"""Sorted 64-bit values packed as byte planes of their differences.

Block-wise exchanges ship sorted, distinct hashes of a block to hash buckets. Differences need far
fewer bytes than hashes, and one row carries thousands of them.
"""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Pack sorted uint64 values: count, first value, width, then differences of that width."""
    n = len(values)
    if not n:
        return b""
    step = np.diff(values)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if n > 1 else 1
    body = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return n.to_bytes(8, "little") + int(values[0]).to_bytes(8, "little") + bytes([width]) + body


def unpack(blob: bytes) -> np.ndarray:
    """The values of ``pack``."""
    if not blob:
        return np.zeros(0, np.uint64)
    n, first, width = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little"), blob[16]
    wide = np.zeros((n - 1, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, offset=17).reshape(-1, width)
    out = np.empty(n, np.uint64)
    out[0] = first
    out[1:] = wide.reshape(-1).view("<u8")
    return np.cumsum(out, dtype=np.uint64)


def cuts(values: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits buckets (by leading bits) begins in sorted ``values``; the end is last."""
    if not bits:
        return np.array([0, len(values)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def bucket_bits(total: float, per_bucket: float, least: int = 3, most: int = 24) -> int:
    """Leading bits so that a bucket holds about ``per_bucket`` of ``total`` items."""
    return min(most, max(least, int(np.ceil(np.log2(max(1.0, total / per_bucket))))))


def planes(values: np.ndarray) -> bytes:
    """Compressed byte planes of non-negative whole numbers, as many planes as the largest value needs."""
    values = np.asarray(values)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    kind = "<u4" if width <= 4 else "<u8"
    raw = values.astype(kind, copy=False).view(np.uint8).reshape(len(values), -1)
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(raw[:, :width].T).tobytes(), 3)


def unplanes(blob: bytes) -> np.ndarray:
    """The values of ``planes`` as uint32, or uint64 where they need more."""
    width = blob[0]
    raw = np.frombuffer(zstandard.decompress(memoryview(blob)[1:]), np.uint8).reshape(width, -1)
    wide = np.zeros((raw.shape[1], 4 if width <= 4 else 8), np.uint8)
    wide[:, :width] = raw.T
    return wide.reshape(-1).view("<u4" if width <= 4 else "<u8")
