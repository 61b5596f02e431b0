"""Vectorised text primitives for Arrow batches: word spans and word hashes without Python strings.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 those bytes occur only
as themselves, so byte runs and code-point runs are the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SEED = np.random.default_rng(20240611)
_CODE = _SEED.integers(1, 2**64, size=256, dtype=U)
_LOWER_CODE = _CODE.copy()
_LOWER_CODE[65:91] = _CODE[97:123]
_OTHER_CODE = _SEED.integers(1, 2**64, size=256, dtype=U)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
CHUNK_BYTES = 1 << 20


def give_back() -> None:
    """Returns the worker's free memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU C library
        pass


def lean(run: Callable) -> Callable:
    """``run`` over a partition's batches, after which the worker gives its free memory back. Workers
    wait for further tasks; else they keep the most that any earlier task needed."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return partition


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse, grown to the longest chunk seen."""

    def __init__(self):
        self.up = self.down = np.ones(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(_BASE, n), powers(_BASE_INV, n)
        return self.up, self.down


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text and ``rows`` rows, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off, _ = strings(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, min(int(np.searchsorted(off, off[at] + most, "right")) - 1, at + rows))
            yield batch.slice(at, end - at)
            at = end


def words(off: np.ndarray, data: np.ndarray, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after, index of the first word of each text and the total) of every word.
    ``space`` says of each byte whether it separates words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    begin = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, off)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, pows: Powers, lower: bool, other: bool = False) -> np.ndarray:
    """64-bit hashes of the words; with ``lower`` A-Z count as a-z. ``other`` gives a second, independent hash."""
    if not len(begin):
        return np.zeros(0, U)
    up, down = pows.get(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((_OTHER_CODE if other else _LOWER_CODE if lower else _CODE)[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] ^ (end - begin).astype(U) * U(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (the last k-1 positions are not filled)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    g = h[:n].copy()
    for j in range(1, k):
        g = mix(g * U(0xA24BAED4963EE407) + h[j : j + n])
    return g


def long_grams(h: np.ndarray, k: int) -> np.ndarray:
    """As ``grams``, by doubling: about 2 log2(k) passes."""

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = min(len(a), len(b))
        return mix(a[:n] * U(0xA24BAED4963EE407) + b[:n])

    if len(h) < k:
        return np.zeros(0, U)
    power, n, out, covered = h, 1, None, 0
    while True:
        if k & n:
            out = power if out is None else join(out, power[covered:])
            covered += n
        n *= 2
        if n > k:
            return out[: len(h) - k + 1]
        power = join(power, power[n // 2 :])


def gram_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the word list, text index) of all k-word windows that lie within one text."""
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    which = np.repeat(np.arange(len(n)), count)
    if not len(which):
        return np.zeros(0, np.int64), which
    within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][which] + within, which
