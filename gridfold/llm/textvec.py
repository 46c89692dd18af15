"""Words of Arrow text columns as numpy arrays: places and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of texts that are worked on at a time, few enough for a processor's cache; a longer
#: single text is a chunk of its own.
CHUNK = 1 << 18
_powers: list[np.ndarray] = []


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`f`, and after it the worker, which later tasks use again, gives back the memory that it freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, from 0 to n at least."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, CHUNK) + 1
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, x, U)]), dtype=U) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ U(seed)) * U(0xFF51AFD7ED558CCD)
        x ^= x >> U(33)
        x *= U(0xC4CEB9FE1A85EC53)
        x ^= x >> U(29)
    return x


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the offsets of its texts."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of texts with at most `most` bytes together, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of runs without ASCII white space, A-Z taken as a-z.

    `breaks` are places where a text begins; no word runs across one.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    space = SPACE[data]
    inner = breaks[(breaks > 0) & (breaks < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum((LOWER[data].astype(U) + U(1)) * down[:n], out=total[1:])
        h = (total[ends] - total[starts]) * up[ends - 1] + (ends - starts).astype(U) * U(0x2545F4914F6CDD1D)
    return starts, ends, mix(h)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words.

    A text of fewer words has its whole sequence as the only one; one without words has none.
    """
    starts, _, h = words(data, offsets[:-1])
    at = np.searchsorted(starts, offsets)
    run = np.zeros(max(len(h) - k + 1, 0), U)
    with np.errstate(over="ignore"):
        for j in range(k):
            run = run * _BASE + h[j : j + len(run)]
    run = mix(run, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(run[a : b - k + 1])
        elif b > a:
            x = U(b - a)
            with np.errstate(over="ignore"):
                for y in h[a:b]:
                    x = x * _BASE + y
            yield mix(np.array([x], U), 0x7F4A7C15)
        else:
            yield np.zeros(0, U)
