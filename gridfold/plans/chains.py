"""Post-processing chains: from a raw mask, its confidence and its edges to a refined mask."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions import pixels as P
from gridfold.operators import kernels, shapes, spatial


def refine(df: DataFrame, prob: str | None = None, close: int = 0, fill: bool = True) -> DataFrame:
    """(frame, y, x, m): threshold or binarise, median, optional closing and hole fill."""
    m = P.below_confidence(F.col(prob)) if prob else P.binarize(F.col("m"))
    out = spatial.close(spatial.median(df.withColumn("m", m), "m", 5), "m", close)
    return shapes.by_frame(out, "m", shapes.fill_holes) if fill else out.select("frame", "y", "x", "m")


def finished(df: pd.DataFrame, confidence: float = 0.5, close: int = 0) -> pd.DataFrame:
    """A whole frame in one pass: its refined mask by confidence, and its composite. For frames
    too large for windows over cells; the same results as `refine`, `spatial.blur`."""
    df = df.sort_values(["y", "x"])
    shape = int(df["y"].max()) + 1, int(df["x"].max()) + 1
    grid = lambda c: df[c].to_numpy().reshape(shape)
    m = kernels.majority(np.where(grid("bg_prob").astype(np.float32) < np.float32(confidence), 255, 0))
    m = np.asarray(shapes.fill_holes(kernels.closed(m, close)))
    image = {c: np.where(m != 0, x, kernels.blurred(x)) for c, x in zip("bgr", map(grid, ("c0", "c1", "c2")))}
    out = df[["stream_id", "frame_id", "y", "x", "mask"]].assign(refined=m.ravel())
    return out.assign(**{c: x.ravel().astype(np.int32) for c, x in image.items()})


def _fill(df: DataFrame) -> DataFrame:
    return shapes.by_frame(df, "m", shapes.fill_holes)


def sizes(short: int) -> tuple[int, int, int]:
    """Elliptic elements that close, grow and shrink, for frames whose shorter side is `short`."""
    return tuple(2 * max(least, int(short * part)) + 1 for least, part in ((3, 0.019), (5, 0.042), (3, 0.027)))


def connect(df: DataFrame, short: int) -> DataFrame:
    """Grow, close, fill every outer contour, shrink."""
    closing, growing, shrinking = sizes(short)
    out = spatial.close_ellipse(spatial.dilate_ellipse(df, "m", growing), "m", closing)
    return spatial.erode_ellipse(shapes.by_frame(out, "m", shapes.contour_fill), "m", shrinking)


def connect_largest(df: DataFrame, short: int, seed: tuple[int, int] = (50, 50)) -> DataFrame:
    """As `connect`, then only the largest component, filled from a seed, and shrunk again."""
    out = shapes.by_frame(connect(df, short), "m", lambda m: shapes.largest_filled(m, seed))
    return spatial.erode_ellipse(out, "m", sizes(short)[2])


def _weak(df: DataFrame) -> DataFrame:
    return df.withColumn("m", P.weak_gate(F.col("edge"), F.col("prob")))


def _strict(df: DataFrame) -> DataFrame:
    return df.withColumn("m", P.strict_gate(F.col("edge"), F.col("prob")))


def chains(short: int, seed: tuple[int, int] = (50, 50)):
    """The chains over (frame, y, x, m, prob, edge), by name, for frames whose shorter side is `short`."""
    return {
        "raw mask": lambda d: d.withColumn("m", P.binarize(F.col("m"))),
        "mask + median": lambda d: refine(d, fill=False),
        "mask + median + fill": lambda d: refine(d),
        "confidence": lambda d: d.withColumn("m", P.below_confidence(F.col("prob"))),
        "confidence + median": lambda d: refine(d, "prob", fill=False),
        "confidence + median + fill": lambda d: refine(d, "prob"),
        "confidence + median + close + fill": lambda d: refine(d, "prob", close=15),
        "weak gate": _weak,
        "weak gate + median": lambda d: spatial.median(_weak(d), "m", 3),
        "weak gate + median + fill": lambda d: _fill(spatial.median(_weak(d), "m", 3)),
        "weak gate + median + contour": lambda d: connect(spatial.median(_weak(d), "m", 3), short),
        "strict gate + median + contour": lambda d: connect(spatial.median(_strict(d), "m", 5), short),
        "strict gate + median + contour + largest + fill": lambda d: connect_largest(spatial.median(_strict(d), "m", 5), short, seed),
    }
