"""Whole-frame mask operators, a numpy kernel for each frame: holes, components, contours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def spread(seed: np.ndarray, inside: np.ndarray, eight: bool = False) -> tuple[np.ndarray, int]:
    """Cells of `inside` reached from `seed`, and the passes that took."""
    got, turns = seed & inside, 0
    while True:
        p = np.pad(got, 1)
        x = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
        if eight:
            x = x | p[:-2, :-2] | p[:-2, 2:] | p[2:, :-2] | p[2:, 2:]
        x &= inside
        turns += 1
        if (x == got).all():
            return got, turns
        got = x


def border(shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, bool)
    out[[0, -1]] = True
    out[:, [0, -1]] = True
    return out


def runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first cell, cell after the last) of each run of cells in a line, in order."""
    wide = np.zeros((on.shape[0], on.shape[1] + 2), np.int8)
    wide[:, 1:-1] = on
    edge = np.diff(wide, axis=1)
    y, first = np.nonzero(edge == 1)
    return y, first, np.nonzero(edge == -1)[1]


def labels(on: np.ndarray, eight: bool = True) -> np.ndarray:
    """Components by number from 1, in the order of their first cells; 0 elsewhere.

    Runs that touch between lines are joined: each takes the least run it is joined to, until
    none changes.
    """
    out = np.zeros(on.shape, np.int32)
    y, a, b = runs(on)
    line, e = on.shape[1] + 2, int(eight)
    low = np.searchsorted(y * line + b, (y + 1) * line + a - e, "right")
    many = np.searchsorted(y * line + a, (y + 1) * line + b + e, "left") - low
    i = np.repeat(np.arange(len(y)), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    root = np.arange(len(y))
    while len(i):
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    out[on] = np.repeat(np.unique(root, return_inverse=True)[1] + 1, b - a)
    return out


def fill_holes(m: np.ndarray) -> np.ndarray:
    """Background that a border can't reach, by side steps, becomes foreground."""
    own = labels(m == 0, eight=False)
    open_ = np.zeros(own.max(initial=0) + 1, bool)
    open_[own[border(m.shape)]] = True
    open_[0] = False
    return np.where(open_[own], 0, 255)


def fill_reconstruct(m: np.ndarray, most: int = 4096) -> tuple[np.ndarray, int]:
    got, turns = spread(border(m.shape), m == 0)
    if turns > most:
        raise RuntimeError(f"no fixpoint after {most} passes")
    return np.where(got, 0, 255), turns


def largest_component(m: np.ndarray) -> np.ndarray:
    own = labels(m != 0)
    if own.max() == 0:
        return m
    return np.where(own == np.bincount(own.ravel())[1:].argmax() + 1, 255, 0)


def contour_fill(m: np.ndarray) -> np.ndarray:
    """Outer contours of 8-connected components, filled: holes count as inside."""
    return fill_holes(np.where(m != 0, 255, 0)) if (m != 0).any() else np.zeros_like(m)


def hole_count(m: np.ndarray) -> int:
    return int(labels((fill_holes(m) == 255) & (m == 0), eight=False).max(initial=0))


def seeded_fill(m: np.ndarray, seed: tuple[int, int] = (50, 50)) -> np.ndarray:
    """Background not reached from one seed joins the mask; a seed outside, or on the mask,
    reaches nothing, so everything does."""
    if seed[0] >= m.shape[0] or seed[1] >= m.shape[1] or m[seed] != 0:
        return np.full(m.shape, 255)
    own = labels(m == 0, eight=False)
    return np.where(own == own[seed], 0, 255)


def largest_filled(m: np.ndarray, seed: tuple[int, int] = (50, 50)) -> np.ndarray:
    """The largest component, and background that `seed` doesn't reach; an empty mask stays."""
    return seeded_fill(largest_component(m), seed) if (m != 0).any() else m


def by_frame(df: DataFrame, col: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`kernel` on the mask `col` of every frame of (frame, y, x, col); one shuffle by frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1), np.int32)
        grid[pdf["y"], pdf["x"]] = pdf[col]
        out = kernel(grid)
        value = np.full(len(pdf), out) if np.ndim(out) == 0 else out[pdf["y"], pdf["x"]]
        return pdf[["frame", "y", "x"]].assign(**{col: value.astype(np.int32)})

    return df.select("frame", "y", "x", col).groupBy("frame").applyInPandas(run, f"frame long, y int, x int, {col} int")
