"""Vectorised text kernels shared by the Arrow-backed operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, a few
megabytes at a time, so that memory stays bounded however large a batch is.
Hashes are polynomial prefix hashes modulo 2**64 over random byte values,
finished with a splitmix64 round; they are the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(_BASE))


_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INV)):
            step = np.full(size, base, U)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which hash_spans reads the hash of any span."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def hash_spans(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(c))[1]
    return mix((c[end] - c[start]) * inverse[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def table(keep: str) -> np.ndarray:
    """256 flags: True for the byte values listed in keep (latin-1)."""
    out = np.zeros(256, bool)
    out[np.frombuffer(keep.encode("latin-1"), np.uint8)] = True
    return out


SPACE = table("\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def pieces(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets from 0) of each chunk."""
    data, offsets = buffers(column)
    for lo, hi in chunks(offsets, most):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero kind inside each row: starts, ends, and where each row's runs begin."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    good = kind[at[:-1]] != 0
    starts, ends = at[:-1][good], at[1:][good]
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs((~space)[data].view(np.uint8), offsets)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every full window, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x
