"""Vectorised kernels over the UTF-8 bytes of an Arrow text column.

Everything here works on one bounded slice of whole documents inside a task:
`slices` cuts a record batch at document borders into pieces of about
SLICE_BYTES (a longer document is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 * 5 % 2**64  # odd, and 3 or 5 modulo 8: a long period
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000003)) | np.uint64(1)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers.get("up", ())) < max(n, 1):
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def running(values: np.ndarray) -> np.ndarray:
    """Sums of values before each place, one longer than values; wraps."""
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end]."""
    up, down = power_tables(len(data))
    sums = running(byte_table(seed)[data] * up)
    at = np.minimum(starts, max(len(data) - 1, 0))
    return mix((sums[ends] - sums[starts]) * (down[at] if len(data) else np.uint64(0)) + (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return data[first:last], offsets - first


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into (rows, bytes, offsets) of whole documents."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the place of each document's first
    word in them (one longer than the documents)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~IS_SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1]] = False  # a word never crosses documents
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owner(firsts: np.ndarray) -> np.ndarray:
    """The document of each item, from the place of each document's first."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def per_doc(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of each document's values."""
    sums = running(values)
    return sums[firsts[1:]] - sums[firsts[:-1]]


def windows(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k items within a document, and the place of
    each run's first item."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * np.uint64(pow(_BASE, 3 * j + 7, 2**64))
    room = np.repeat(firsts[1:], np.diff(firsts))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= room)
    return mix(total[at]), at


def list_column(values: np.ndarray, firsts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(values, kind))
