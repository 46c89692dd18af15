"""Bitmaps over hashes of keys, sized by the number of keys, built from sparse lists of places.

They steer work only: a key that isn't in one can't matter, one that is may.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridfold.llm import textvec as V
from gridfold.llm.textvec import U

#: Bits a key; smallest and largest bitmap in bits. Beyond 2^30 (128 MB) it fills with the
#: data: more keys than needed pass, never fewer.
PER_KEY, LEAST, MOST = 8, 20, 30
#: Bits of a block, the unit that meets in a task.
BLOCK = 20
#: Places that a task holds at a time.
HELD = 1 << 21


def bits_for(keys: int) -> int:
    return 1 << min(MOST, max(LEAST, (max(keys, 1) * PER_KEY - 1).bit_length()))


def place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (V.mix(keys.astype(np.int64).view(U)) & U(bits - 1)).astype(np.int64)


def bitmap(keys: DataFrame, bits: int, twice: bool = False) -> np.ndarray:
    """A bitmap over a column of longs: of keys seen, or of those whose bit was seen twice.

    Tasks send the sorted places of their keys, 4 bytes each, by blocks; never whole bitmaps.
    """

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            block = at >> BLOCK
            first = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(first[1:], len(at))
            low = (at & ((1 << BLOCK) - 1)).astype(np.uint32) << np.uint32(1) | (times > 1).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int32()), pa.array([low[x:y].tobytes() for x, y in zip(first, ends)], pa.binary())], ["block", "data"])

        held, n = [], 0
        for b in batches:
            held.append(place(b.column(0).to_numpy(zero_copy_only=False), bits))
            n += len(held[-1])
            if n >= HELD:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_buffer(), np.uint32)
                seen = got.setdefault(i, np.zeros(1 << BLOCK, np.uint8))
                at = x >> np.uint32(1)
                seen[at] = np.minimum(seen[at] + np.uint8(1) + (x & np.uint32(1)).astype(np.uint8), 2)
        least = 2 if twice else 1
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([np.packbits(x >= least).tobytes() for x in got.values()], pa.binary())], ["block", "data"])

    out = np.zeros(bits // 8, np.uint8)
    size = (1 << BLOCK) // 8
    dealt = keys.mapInArrow(V.lean(sparse), "block int, data binary").repartition("block")
    for i, x in dealt.mapInArrow(V.lean(merge), "block int, data binary").collect():
        out[i * size : (i + 1) * size] = np.frombuffer(x, np.uint8)
    return out
