"""From colour frames to refined masks, composites and scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions import pixels as P
from gridfold.operators import evaluate, mixture, planes, spatial
from gridfold.params import Params
from gridfold.plans import chains
from gridfold.sources import carriers

KEY = ["stream_id", "frame_id", "y", "x"]


def _by_cells(frames: DataFrame, params: Params, update: float, colour: str) -> DataFrame:
    if colour == "ycrcb":
        frames = frames.select(*KEY, *(c.alias(f"c{i}") for i, c in enumerate(P.ycrcb(F.col("c0"), F.col("c1"), F.col("c2")))))
    return mixture.fold(frames, params, update)


def _by_frames(frames: DataFrame, params: Params, update: float, colour: str) -> DataFrame:
    return planes.cells_of_folded(planes.fold(carriers.frames_of(frames), params, update, colour))


#: The ways to fold, with equal results: a row for each cell, or frames as binary rows (complete
#: grids of bytes, no modes passed between neighbours).
WAYS = {"cells": _by_cells, "frames": _by_frames}


def model(frames: DataFrame, params: Params = Params(), update: float = -1.0, colour: str = "ycrcb", way: str = "cells") -> DataFrame:
    """The fold of blue-green-red frames (KEY, c0, c1, c2) in a colour space, `ycrcb` or `bgr`, in
    one of WAYS."""
    if colour not in ("ycrcb", "bgr"):
        raise ValueError(f"no colour space {colour}")
    if way not in WAYS:
        raise ValueError(f"no way {way}; there are {sorted(WAYS)}")
    return WAYS[way](frames, params, update, colour)


def keyed(df: DataFrame) -> DataFrame:
    """`df` with the stream and the number of a frame as its one key, for the mask operators."""
    return df.withColumn("frame", F.struct("stream_id", "frame_id")).drop("stream_id", "frame_id")


def blur_background(frames: DataFrame, params: Params = Params(), update: float = -1.0, colour: str = "ycrcb", close: int = 0) -> DataFrame:
    """(KEY, mask, refined, b, g, r): the model's mask, the refined one, and the frame whose
    background is blurred. Frames are complete grids; a fold, then one pass by frame."""
    folded = model(frames, params, update, colour)
    both = frames.join(folded.select(*KEY, "mask", "bg_prob"), KEY)
    return both.groupBy("stream_id", "frame_id").applyInPandas(
        lambda df: chains.finished(df, params.confidence, close),
        "stream_id string, frame_id long, y int, x int, mask int, refined int, b int, g int, r int",
    )


def score(frames: DataFrame, truth: DataFrame, roi: DataFrame, names: Sequence[str], since: int = 1, params: Params = Params(), update: float = -1.0, colour: str = "ycrcb") -> DataFrame:
    """A row for each chain: tp, fp, fn and scores over the scorable cells of frames from `since`
    on, and the frames without foreground among these cells. Earlier frames are folded, not scored.

    `truth` has a value for each cell (KEY, truth), `roi` one for each place (y, x, roi), which
    counts where it isn't 0; the region is broadcast, it has the size of one frame.
    """
    folded = keyed(model(frames, params, update, colour)).select("frame", "y", "x", F.col("mask").alias("m"), F.col("bg_prob").alias("prob"))
    every = chains.chains(0)
    each = [every[x](folded).select("frame", "y", "x", F.lit(x).alias("chain"), F.col("m").alias("pred")) for x in names]
    both = reduce(DataFrame.unionByName, each).where(F.col("frame.frame_id") >= since)
    both = both.join(keyed(truth), ["frame", "y", "x"]).join(F.broadcast(roi), ["y", "x"])
    both = both.where(P.scorable(F.col("truth"), F.col("roi") != 0))
    empty = both.groupBy("chain", "frame").agg(F.max("pred").alias("top")).groupBy("chain").agg(F.count_if(F.col("top") < 255).alias("empty"))
    return evaluate.metrics(evaluate.confusion(both, ["chain"])).join(empty, "chain")
