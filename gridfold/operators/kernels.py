"""Stencils on whole frames as numpy kernels: what `spatial` does with windows over cells."""

from __future__ import annotations

import functools

import numpy as np

from gridfold.params import BLUR_TAPS


def majority(m: np.ndarray, size: int = 5) -> np.ndarray:
    """The median of a mask of 0 and 255; beyond the border its last value stands."""
    r, out = size // 2, (m == 255).astype(np.uint8 if size < 16 else np.int32)
    for axis in (0, 1):
        wide = np.pad(out, [(r, r) if i == axis else (0, 0) for i in range(2)], "edge")
        n = m.shape[axis]
        out = functools.reduce(np.add, (wide[:, i : i + n] if axis else wide[i : i + n] for i in range(size)))
    return np.where(out > size * size // 2, 255, 0)


def closed(m: np.ndarray, size: int) -> np.ndarray:
    """Closing by a square; what lies beyond the border doesn't count."""
    if size <= 1:
        return m
    r = size // 2
    for best, edge in ((np.maximum, 0), (np.minimum, 255)):
        for axis in (0, 1):
            wide = np.pad(m, [(r, r) if i == axis else (0, 0) for i in range(2)], constant_values=edge)
            n = m.shape[axis]
            m = functools.reduce(best, (wide[:, i : i + n] if axis else wide[i : i + n] for i in range(2 * r + 1)))
    return m


def blurred(c: np.ndarray, taps: tuple[int, ...] = BLUR_TAPS) -> np.ndarray:
    """The blur in 1/256: no rounding between the passes, (sum + 32768) >> 16 after both."""
    r, c = len(taps) // 2, c.astype(np.int32)
    for axis in (1, 0):
        if c.shape[axis] > 1:
            wide = np.pad(c, [(r, r) if i == axis else (0, 0) for i in range(2)], "reflect")
        else:
            wide = np.repeat(c, len(taps), axis)
        out = np.empty_like(c)
        for top in range(0, len(c), 32):  # a few lines at a time, which stay in the cache
            rows = slice(top, min(top + 32, len(c)))
            n, lines = c.shape[axis], rows.stop - top
            at = (lambda i: wide[rows, i : i + n]) if axis else (lambda i: wide[top + i : top + i + lines])
            total = at(r) * taps[r]
            for i, t in enumerate(taps[r + 1 :], 1):
                pair = at(r - i) + at(r + i)
                pair *= t
                total += pair
            out[rows] = total
        c = out
    c += 32768
    c >>= 16
    return c


def ycrcb(c: np.ndarray) -> np.ndarray:
    """Luma and chroma (3, cells) of blue, green and red, as `pixels.ycrcb` has them."""
    b, g, r = c.astype(np.int32)
    y = (b * 1868 + g * 9617 + r * 4899 + 8192) >> 14
    half = (128 << 14) + 8192
    return np.clip(np.stack([y, ((r - y) * 11682 + half) >> 14, ((b - y) * 9241 + half) >> 14]), 0, 255)


def resized(c: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize of a plane: centres are aligned, values beyond the border are its own."""

    def weights(n: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(out) + 0.5) * n / out - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), at - low

    (a, b, p), (l, r, q) = weights(c.shape[0], height), weights(c.shape[1], width)
    c = c.astype(np.float64)
    rows = c[a] * (1 - p)[:, None] + c[b] * p[:, None]
    return np.rint(rows[:, l] * (1 - q) + rows[:, r] * q).astype(np.int32)
