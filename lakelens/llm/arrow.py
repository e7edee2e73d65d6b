"""Numpy views of Arrow columns, and words and hashes of whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd multiplier and its inverse modulo 2**64, for rolling polynomials.
P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls as one array, and the n + 1 offsets of its values."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, and how many words each text has.

    Words are runs of anything but space and 0x09 to 0x0D, A-Z lower-cased; they end where a text ends.
    """
    n = len(data)
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not n:
        return np.zeros(0, np.uint64), counts
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[1:-1][offsets[1:-1] < n]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low * powers(P, n), out=total[1:])
    h = mix64((total[e] - total[s]) * powers(P_INV, n)[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    counts[:] = np.diff(np.searchsorted(s, offsets))
    return h, counts
