"""Vectorised text primitives over Arrow batches: bytes, words, rolling hashes, segment reductions.

A batch of texts is one ``uint8`` array and row offsets. Batches are cut to about ``LIMIT`` bytes (a longer text stands
alone), so working memory does not follow the batch size Spark happens to send.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

LIMIT = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64

#: Word separators of the query contracts: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, limit: int = LIMIT) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(row slice, bytes, offsets) of runs of rows of at most ``limit`` bytes; longer rows stand alone."""
    data, off = column_bytes(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield slice(a, b), data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U64), np.full(n, pow(BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    up, down = _powers(max(LIMIT + 1, 1 << int(n).bit_length()))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s] the polynomial of symbols s to e, shifted by BASE**s."""
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum((symbols.astype(U64) + U64(1)) * powers(len(symbols) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans s to e of the sequence whose prefix_hash is h."""
    return mix((h[e] - h[s]) * powers(len(h))[1][s] + (e - s).astype(U64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and row offsets into them."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    s, e = solid.copy(), solid.copy()
    s[1:] &= ~solid[:-1] | edge[1:-1]
    e[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, off)


def rows_of(off: np.ndarray) -> np.ndarray:
    """The row of each element, from row offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def shingles(word_hash: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words, and their row offsets; a row of fewer words (one at least) has one shingle of all."""
    h = prefix_hash(mix(word_hash))
    count = np.diff(off)
    got = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    new = np.concatenate(([0], np.cumsum(got)))
    at = np.arange(new[-1]) - np.repeat(new[:-1] - off[:-1], got)
    return span_hash(h, at, np.minimum(at + n, np.repeat(off[1:], got))), new


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


@lru_cache(maxsize=8)
def hash_family(slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``slots`` 32-bit linear permutations."""
    x = mix(np.arange(2 * slots, dtype=U64) + U64(seed * 1_000_003 + 1))
    return (x[:slots] >> U64(32)).astype(np.uint32) | np.uint32(1), (x[slots:] >> U64(32)).astype(np.uint32)


def minhash(x: np.ndarray, off: np.ndarray, slots: int, seed: int = 0) -> np.ndarray:
    """(rows, slots) least values of each permutation over each row's elements; a row without any has the top value."""
    out = np.full((slots, len(off) - 1), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        low, at = (x >> U64(32)).astype(np.uint32), off[full]
        v = np.empty_like(low)
        for i, (a, b) in enumerate(zip(*hash_family(slots, seed), strict=True)):
            np.multiply(low, a, out=v)
            v += b
            out[i, full] = np.minimum.reduceat(v, at)
    return np.ascontiguousarray(out.T)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(value, rows) of each run of an integer column in each batch; earlier batches are not held."""
    for b in batches:
        ids = b[column].to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for first, last in zip(cut, cut[1:], strict=False):
            if first < last:
                yield int(ids[first]), b.slice(first, last - first)


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(value, its batches) of batches that are sorted by an integer column."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        ids = b[column].to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for first, last in zip(cut, cut[1:], strict=False):
            if first == last:
                continue
            if held and ids[first] != key:
                yield key, held
                held = []
            key = int(ids[first])
            held.append(b.slice(first, last - first))
    if held:
        yield key, held
