"""Stencils on pixels (frame, y, x, value) as windows, horizontal then vertical."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridfold.operators import kernels
from gridfold.params import BLUR_TAPS


def row():
    return Window.partitionBy("frame", "y").orderBy("x")


def column():
    return Window.partitionBy("frame", "x").orderBy("y")


def _replicated_sum(c: Column, at: Column, w, r: int) -> Column:
    """The sum of 2r + 1 neighbours; beyond the border its last value stands."""
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left, right = F.greatest(r - at, F.lit(0)), F.greatest(at + r - F.max(at).over(every), F.lit(0))
    return F.sum(c).over(w.rowsBetween(-r, r)) + left * F.first(c).over(every) + right * F.last(c).over(every)


def median(df: DataFrame, col: str, size: int = 5) -> DataFrame:
    """The median of a mask of 0 and 255: the majority of size x size cells."""
    r = size // 2
    df = df.withColumn("_s", F.when(F.col(col) == 255, 1).otherwise(0))
    df = df.withColumn("_s", _replicated_sum(F.col("_s"), F.col("x"), row(), r))
    df = df.withColumn("_s", _replicated_sum(F.col("_s"), F.col("y"), column(), r))
    return df.withColumn(col, F.when(F.col("_s") >= size * size // 2 + 1, 255).otherwise(0)).drop("_s")


def dilate(df: DataFrame, col: str, r: int) -> DataFrame:
    return df.withColumn(col, F.max(col).over(row().rowsBetween(-r, r))).withColumn(col, F.max(col).over(column().rowsBetween(-r, r)))


def erode(df: DataFrame, col: str, r: int) -> DataFrame:
    return df.withColumn(col, F.min(col).over(row().rowsBetween(-r, r))).withColumn(col, F.min(col).over(column().rowsBetween(-r, r)))


def close(df: DataFrame, col: str, size: int) -> DataFrame:
    return erode(dilate(df, col, size // 2), col, size // 2) if size > 1 else df


def ellipse(size: int) -> list[tuple[int, int]]:
    """(dy, half width) of each line of an elliptic element of odd size."""
    r = size // 2
    return [(dy, round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0) for dy in range(-r, r + 1)]


def _elliptic(df: DataFrame, col: str, size: int, of, best) -> DataFrame:
    """An extreme over an ellipse: one along each line for every width, then one across lines.
    What lies beyond the border doesn't count."""
    lines, w = ellipse(size), column()
    df = df.withColumns({f"_e{k}": of(col).over(row().rowsBetween(-k, k)) for k in {k for _, k in lines}})
    near = [F.lag(f"_e{k}", -dy).over(w) for dy, k in lines]
    out = df.withColumn(col, best(*near) if len(near) > 1 else near[0])
    return out.drop(*(f"_e{k}" for k in {k for _, k in lines}))


def dilate_ellipse(df: DataFrame, col: str, size: int) -> DataFrame:
    return _elliptic(df, col, size, F.max, F.greatest)


def erode_ellipse(df: DataFrame, col: str, size: int) -> DataFrame:
    return _elliptic(df, col, size, F.min, F.least)


def close_ellipse(df: DataFrame, col: str, size: int) -> DataFrame:
    return erode_ellipse(dilate_ellipse(df, col, size), col, size) if size > 1 else df


def sobel(df: DataFrame, col: str, out: str = "edge") -> DataFrame:
    """Mean of the saturated absolute gradients; the border is mirrored without its edge."""

    def sides(c: str, w) -> tuple[Column, Column]:
        a, b = F.lag(c, 1).over(w), F.lead(c, 1).over(w)
        return F.coalesce(a, b, F.col(c)), F.coalesce(b, a, F.col(c))

    (l, r) = sides(col, row())
    df = df.withColumns({"_d": r - l, "_s": l + 2 * F.col(col) + r})
    (du, dd), (su, sd) = sides("_d", column()), sides("_s", column())
    # each gradient is a byte of its own, rounded and saturated, before the mean
    gx, gy = (F.least(F.rint(F.abs(g)), F.lit(255.0)) for g in (du + 2 * F.col("_d") + dd, sd - su))
    half = (gx + gy) * F.lit(0.5)
    return df.withColumn(out, F.rint(half).cast("int")).drop("_d", "_s")


def blur(df: DataFrame, col: str, taps=BLUR_TAPS) -> DataFrame:
    """Separable blur in 1/256: no rounding between the passes, (sum + 32768) >> 16 after both.

    A numpy kernel for each frame, which a task holds as a whole; one shuffle by frame.
    """

    def run(t: pa.Table) -> pa.Table:
        y, x = t["y"].to_numpy(), t["x"].to_numpy()
        grid = np.zeros((y.max() + 1, x.max() + 1), np.int32)
        grid[y, x] = t[col].to_numpy()
        return t.set_column(t.schema.get_field_index(col), col, pa.array(kernels.blurred(grid, tuple(taps))[y, x].astype(np.int32)))

    schema = T.StructType([T.StructField(f.name, T.IntegerType()) if f.name == col else f for f in df.schema])
    return df.groupBy("frame").applyInArrow(run, schema)


def composite(mask: Column, original: Column, blurred: Column) -> Column:
    return F.when(mask != 0, original).otherwise(blurred)
