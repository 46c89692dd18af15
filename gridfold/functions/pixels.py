"""Column expressions on pixels: colours, thresholds, the learning rate, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("int")


def ycrcb(b: Column, g: Column, r: Column, clamp: bool = True) -> tuple[Column, Column, Column]:
    """Fixed-point luma and chroma of a blue-green-red pixel, clamped to a byte, or as floats
    that aren't."""
    y = F.shiftright(b * 1868 + g * 9617 + r * 4899 + 8192, 14)
    cr = F.shiftright((r - y) * 11682 + (128 << 14) + 8192, 14)
    cb = F.shiftright((b - y) * 9241 + (128 << 14) + 8192, 14)
    return tuple(_byte(c) if clamp else c.cast("float") for c in (y, cr, cb))


def bgr(y: Column, cr: Column, cb: Column) -> tuple[Column, Column, Column]:
    """The inverse of `ycrcb` in fixed point, clamped to a byte."""
    cr, cb = cr - 128, cb - 128
    part = lambda x: _byte(y + F.shiftright(x + 8192, 14))
    return part(cb * 29049), part(cb * -5636 + cr * -11698), part(cr * 22987)


def bus_bytes(height: Column, width: Column, fused: bool) -> Column:
    """Bytes that cross the bus for a frame: 8 a pixel with all steps on the device, else 17."""
    return height * width * (8 if fused else 17)


def grey(b: Column, g: Column, r: Column) -> Column:
    return (b * 0.114 + g * 0.587 + r * 0.299).cast("float")


def learning_rate(n: Column, rate: float = -1.0, history: int = 250) -> Column:
    """The rate of the n-th frame (from 1): `rate` if not negative, but never on the first."""
    ramp = 1.0 / F.least(2 * n, F.lit(history))
    return ramp if rate < 0 else F.when(n > 1, F.lit(rate)).otherwise(ramp)


def below_confidence(prob: Column, threshold: float = 0.5) -> Column:
    return F.when(prob.cast("float") < F.lit(threshold).cast("float"), 255).otherwise(0)


def binarize(mask: Column) -> Column:
    return F.when(mask == 255, 255).otherwise(0)


def gate(edge: Column, prob: Column, least_edge: int, most_prob: float) -> Column:
    p = F.lit(most_prob).cast("float")
    return F.when((edge >= least_edge) & (prob.cast("float") <= p), 255).otherwise(0)


def weak_gate(edge: Column, prob: Column) -> Column:
    return gate(edge, prob, 1, 0.4)


def strict_gate(edge: Column, prob: Column) -> Column:
    return gate(edge, prob, 10, 0.2)


def scorable(truth: Column, inside: Column) -> Column:
    return inside & truth.isin(0, 255)


def precision(tp: Column, fp: Column) -> Column:
    return tp / F.greatest(tp + fp, F.lit(1))


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(p + r, F.lit(1e-9))


def iou(tp: Column, fp: Column, fn: Column) -> Column:
    return tp / F.greatest(tp + fp + fn, F.lit(1))


def blur_taps(size: int = 15, sigma: float = 5.0) -> list[int]:
    """A Gaussian in 1/256 that sums to 256: differences of the rounded running sum."""
    if size < 3 or size % 2 == 0:
        raise ValueError("the size must be odd and at least 3")
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    g = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    total, run, out = sum(g), 0.0, []
    for x in g:
        before = round(256 * run / total)
        run += x
        out.append(round(256 * run / total) - before)
    return out
