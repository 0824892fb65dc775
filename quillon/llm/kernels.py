"""Vectorised byte kernels shared by the Arrow-backed operators.

Texts arrive as Arrow batches; the kernels work on slices of about a megabyte, so memory is bounded by the slice (or
by the longest single text), never by the batch. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, list[np.ndarray]] = {k: [np.ones(1, U), np.ones(1, U)] for k in range(len(_BASES))}

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n, of one of the bases p."""
    held = _POWERS[base]
    if len(held[0]) < n:
        size = max(n, 1 << 20)
        for k, p in enumerate((_BASES[base], pow(_BASES[base], -1, 1 << 64))):
            a = np.full(size, p, U)
            a[0] = 1
            held[k] = np.multiply.accumulate(a)
    return held[0][:n], held[1][:n]


def prefix_hash(data: np.ndarray, base: int = 0) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * p**position over i..j-1, modulo 2**64."""
    pw, _ = powers(len(data), base)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * pw, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Position-independent hash of each byte range."""
    _, inv = powers(len(prefix), base)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows within the bytes) in slices of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null(b"") if pa.types.is_large_binary(column.type) else column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], (off[i : j + 1] - off[i]).astype(np.int64)
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the index of its first word (one entry more than rows)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


_K = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD)]


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its lower-cased word shingles.

    Fewer words than ``size``: the whole sequence is the one shingle; no words: empty.
    """
    s, e, first = words(data, off)
    h = range_hash(prefix_hash(LOWER[data]), s, e)
    if len(h) >= size:
        acc = np.zeros(len(h) - size + 1, U)
        for k in range(size):
            acc += h[k : len(h) - size + 1 + k] * _K[k % 5] * U(2 * (k // 5) + 1)
        acc = mix(acc)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            u = np.sort(acc[a : b - size + 1])
            yield u[np.concatenate(([True], u[1:] != u[:-1]))]
        elif n:
            x = np.array([n], U)
            for k in range(a, b):
                x = mix(x * _K[1] + h[k : k + 1])
            yield x
        else:
            yield np.zeros(0, U)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return x.astype(U, copy=False).view(np.int64)
