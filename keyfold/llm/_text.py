"""Array code shared by the text operators: Arrow text columns cut into words and hashed.

A text column arrives as one byte buffer with row offsets.  Words are maximal runs of bytes
other than 0x20 and 0x09-0x0D; all of those are ASCII, so cutting bytes equals cutting code
points.  Hashes are 64 bits wide and do not depend on batch, slice or partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CONTINUATION = (np.arange(256) & 0xC0) == 0x80

_BYTE = np.random.default_rng(20240201).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _power.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        _power[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def tidy() -> None:
    """Gives memory that is not in use back to the system: what Arrow's pool and the C library keep of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """run(batches) of a worker, tidied up after each partition: workers stay for the stages that follow."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def slices(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows of a string column, about limit bytes at a time, as (first, end, bytes, offsets).

    A row longer than limit comes alone and whole.  Null texts count as empty.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hash(buf: np.ndarray, folded: bool = False) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE_FOLDED if folded else _BYTE)[buf] * _powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    return mix((prefix[ends] - prefix[starts]) * _powers(_BASE_INVERSE, len(prefix))[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    starts: np.ndarray  # byte positions in the slice
    ends: np.ndarray
    first: np.ndarray  # rows + 1: words of row r are first[r]:first[r + 1]
    hashes: np.ndarray


def words(buf: np.ndarray, offsets: np.ndarray, folded: bool = False, prefix: np.ndarray | None = None) -> Words:
    """The words of each row; folded hashes ignore the case of A-Z."""
    n = len(buf)
    space = SPACE[buf]
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = space
    before[offsets] = True
    after = np.empty(n + 1, bool)
    after[1:n] = space[1:]
    after[n] = True
    after[offsets] = True
    starts = np.flatnonzero(before[:n] & ~space)
    ends = np.flatnonzero(after[1:] & ~space) + 1
    if prefix is None:
        prefix = prefix_hash(buf, folded)
    return Words(starts, ends, np.searchsorted(starts, offsets), span_hash(prefix, starts, ends))


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
