"""Scores of masks against truth, and comparison of two results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.functions import pixels as P
from gridfold.operators import kernels, shapes, spatial
from gridfold.params import BLUR_TAPS, Params


def confusion(df: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """tp, fp, fn of scorable rows, for each group."""
    on, real = F.col(pred) == 255, F.col(truth) == 255
    return df.groupBy(*by).agg(F.count_if(on & real).alias("tp"), F.count_if(on & ~real).alias("fp"), F.count_if(~on & real).alias("fn"))


def metrics(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = df.withColumns({"p": P.precision(tp, fp), "r": P.precision(tp, fn), "iou": P.iou(tp, fp, fn)})
    return df.withColumn("f1", P.f1(F.col("p"), F.col("r")))


def leaderboard(df: DataFrame) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in ("f1", "iou", "p", "r", "empty", "chain")))


def mask_diff(a: DataFrame, b: DataFrame, key: list[str], col: str) -> DataFrame:
    """For each frame how many cells differ."""
    both = a.select(*key, F.col(col).alias("_a")).join(b.select(*key, F.col(col).alias("_b")), key)
    return both.groupBy("frame").agg(F.count_if(F.col("_a") != F.col("_b")).alias("differ"))


def cumulative(df: DataFrame, col: str = "differ", by: tuple[str, ...] = ()) -> DataFrame:
    """The running total over frames, of each stream if `by` names one; a row a frame, so that a
    task orders one stream's frames, not their cells."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(col).over(w))


def first_divergence(a: DataFrame, b: DataFrame, key: list[str], least: float = 1e-4) -> DataFrame:
    """Of each pixel the first frame where the two background probabilities part."""
    both = a.select(*key, "frame_id", F.col("bg_prob").alias("_a")).join(b.select(*key, "frame_id", F.col("bg_prob").alias("_b")), [*key, "frame_id"])
    return both.where(F.abs(F.col("_a") - F.col("_b")) > least).groupBy(*key).agg(F.min("frame_id").alias("first_frame"))


#: How near two states, and two margins for each unit of their scale, have to be.
CLOSE = 1e-3


def seed_proofs(a, b, x: np.ndarray, params: Params = Params()) -> np.ndarray:
    """Of P pixels with states a, b = (n, w, v, m) before a frame x (C, P): whether the states are
    close, and some decision that both come to falls on either side of its margin."""
    (na, *one), (nb, *two) = a, b
    w, v, m = (np.stack(pair) for pair in zip(one, two))
    k = np.arange(params.modes)[:, None]
    live = k < np.minimum(na, nb)
    gaps = np.concatenate([np.abs(x[0] - x[1]).reshape(len(k), -1, len(na)) for x in (w, v, m)], axis=1)
    alike = (na == nb) & ((gaps < CLOSE) | ~live[:, None]).all((0, 1))
    # distances are summed channel by channel in single precision, as the fold does
    far = np.add.accumulate((m[:, :, : len(x)] - x.astype(np.float32)) ** 2, axis=2, dtype=np.float32)[:, :, -1]
    limits = np.float32([params.background_threshold, params.generation_threshold])[:, None, None, None]
    margins = (far - limits * v).astype(np.float64)
    fits = live & (margins[1] < 0)
    # a mode is reached on both sides if none before it fits on either
    reached = live & ((np.cumsum(fits, axis=1) - fits) == 0).all(0)
    low, high = margins.min(1), margins.max(1)
    scale = np.maximum(limits[0, 0] * v.max(0), 1)
    parted = (low <= 0) & (high >= 0) & (low < high) & (high - low < CLOSE * scale)
    return alike & (parted & reached).any((0, 1))


def seeds(a: DataFrame, b: DataFrame, pixels: DataFrame, params: Params = Params(), least: float = 1e-4) -> DataFrame:
    """(stream_id, y, x, frame_id, proven): of each pixel the first frame where two folds with
    snapshots part, and whether their states before it prove that rounding parted them."""
    key = ["stream_id", "y", "x"]
    before = Window.partitionBy(*key).orderBy("frame_id")

    def lagged(df: DataFrame, side: str) -> DataFrame:
        held = [F.lag(c).over(before).alias(f"{c}_{side}") for c in ("n", "w", "v", "m")]
        return df.select(*key, "frame_id", F.col("bg_prob").alias(f"p_{side}"), *held)

    both = lagged(a, "a").join(lagged(b, "b"), [*key, "frame_id"]).where(F.abs(F.col("p_a") - F.col("p_b")) > least)
    first = both.withColumn("_at", F.row_number().over(before)).where("_at = 1").join(pixels, [*key, "frame_id"])
    k, c = params.modes, params.channels

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            known = df["n_a"].notna() & df["n_b"].notna()
            out, own = df[[*key, "frame_id"]].assign(proven=False), df[known]
            if len(own):
                sides = []
                for s in "ab":
                    w, v, m = (np.stack(own[f"{x}_{s}"].to_list()).astype(np.float32).T for x in "wvm")
                    more = (0, max(0, k - len(w)))  # a side may hold fewer modes
                    w, v, m = (np.pad(x, [more] + [(0, 0)] * (x.ndim - 1)) for x in (w, v, m.reshape(len(w), c, -1)))
                    sides.append((own[f"n_{s}"].to_numpy(int), w, v, m))
                x = own[["c0", "c1", "c2"][:c]].to_numpy(np.float32).T
                out.loc[known, "proven"] = seed_proofs(*sides, x, params)
            yield out

    return first.mapInPandas(prove, "stream_id string, y int, x int, frame_id long, proven boolean")


def pruned_modes(result: DataFrame) -> DataFrame:
    """How many modes each frame has fewer than the one before, by pixel, and their sum."""
    w = Window.partitionBy("stream_id", "y", "x").orderBy("frame_id")
    fewer = F.greatest(F.lag("n").over(w) - F.col("n"), F.lit(0))
    return result.withColumn("fewer", fewer).groupBy("stream_id", "y", "x").agg(F.sum("fewer").alias("pruned"))


CELLS = "stream_id string, frame_id long, y int, x int, a float, b float, c0 int, c1 int, c2 int, edge boolean, cascade boolean, real boolean"
COUNTS = ("pixels", "flips", "at_threshold", "cascaded", "unexplained", "prefill_differ", "refined_differ", "composite_differ")


def whole_frame(df: pd.DataFrame) -> pd.DataFrame:
    """A frame's cells with those it lacks: background on both sides, and black."""
    y, x = np.indices((df["y"].max() + 1, df["x"].max() + 1)).reshape(2, -1)
    out = pd.DataFrame({"y": y, "x": x}).merge(df.assign(real=True), "left", ["y", "x"])
    out = out.fillna({"a": 1.0, "b": 1.0, "c0": 0, "c1": 0, "c2": 0}).assign(**{c: out[c].eq(True) for c in ("edge", "cascade", "real")})
    return out.assign(stream_id=df["stream_id"].iloc[0], frame_id=df["frame_id"].iloc[0])[[c.split()[0] for c in CELLS.split(", ")]]


def blurred(c: np.ndarray) -> np.ndarray:
    """The blur of a channel, apart from `spatial.blur`, which it checks."""
    r, c = len(BLUR_TAPS) // 2, c.astype(np.int64)
    for axis in (1, 0):
        wide = np.pad(c, [(r, r) if i == axis else (0, 0) for i in range(2)], "reflect")
        c = sum(t * np.take(wide, range(i, i + c.shape[axis]), axis) for i, t in enumerate(BLUR_TAPS))
    return (c + 32768) >> 16


def compare_frame(df: pd.DataFrame, threshold: float = 0.5, channels: int = 3) -> pd.DataFrame:
    """The counts of a whole frame with masks before the fill (pre_a, pre_b) and blurred channels
    (s0 ..), whether an integer stage is at fault, and whether the second side has foreground."""
    df = df.sort_values(["y", "x"])
    shape = df["y"].max() + 1, df["x"].max() + 1
    grid = lambda c: df[c].to_numpy().reshape(shape)
    raw = [np.where(grid(c).astype(np.float32) < np.float32(threshold), 255, 0) for c in "ab"]
    pre = [grid(c).astype(np.int32) for c in ("pre_a", "pre_b")]
    refined = [np.asarray(shapes.fill_holes(p)) for p in pre]
    image, soft = (np.stack([grid(f"{s}{i}").astype(np.int64) for i in range(channels)]) for s in "cs")
    whole = [np.where(m != 0, image, soft) for m in refined]
    flip, edge, cascade = raw[0] != raw[1], grid("edge").astype(bool), grid("cascade").astype(bool)
    differ = [int((two[0] != two[1]).sum()) for two in (pre, refined, whole)]
    fault = any((kernels.majority(r) != p).any() for r, p in zip(raw, pre)) or any((blurred(c) != b).any() for c, b in zip(image, soft))
    fault |= bool(differ[0] and not flip.any() or differ[1] and not differ[0] or differ[2] and not differ[1])
    # flips that the median takes away need no explanation
    unexplained = int((flip & ~edge & ~cascade).sum()) if differ[0] else 0
    counts = (int(df["real"].sum()), int(flip.sum()), int((flip & edge).sum()), int((flip & ~edge & cascade).sum()), unexplained, *differ)
    return pd.DataFrame([(*counts, fault, bool((refined[1] == 255).any()))], columns=[*COUNTS, "fault", "foreground"])


def verdict(a: DataFrame, b: DataFrame, pixels: DataFrame, params: Params = Params(), least: float = 1e-4, since: int = 0) -> DataFrame:
    """One row on two folds with snapshots over `pixels`, from frame `since` on: decisions that
    flip; how many of them lie at the threshold, how many are cascaded (at or after a seed of
    their pixel that is proven, see `seeds`), and how many are neither in frames whose masks
    differ; cells that differ before the hole fill and after, and channel values of the
    composite; whether an integer stage is at fault, and the verdict.

    An integer stage is at fault where its results differ though what it was given doesn't, or
    where the median or the blur isn't what plain arrays give. Without any foreground of `b`
    the verdict is DEGENERATE. Cells that a frame lacks are background.
    """
    key = ["stream_id", "y", "x"]
    side = lambda df, name: df.select(*key, "frame_id", F.col("bg_prob").cast("float").alias(name))
    both = side(a, "a").join(side(b, "b"), [*key, "frame_id"]).join(pixels, [*key, "frame_id"]).where(F.col("frame_id") >= since)
    proven = seeds(a, b, pixels, params, least).where("proven").select(*key, F.col("frame_id").alias("_since"))
    both = both.join(proven, key, "left")
    flip = P.below_confidence(F.col("a"), params.confidence) != P.below_confidence(F.col("b"), params.confidence)
    channels = [F.col(f"c{i}").cast("int").alias(f"c{i}") if i < params.channels else F.lit(0).alias(f"c{i}") for i in range(3)]
    cells = both.select(
        "stream_id", "frame_id", "y", "x", "a", "b", *channels,
        (flip & (F.abs(F.col("a").cast("double") - F.col("b").cast("double")) < least)).alias("edge"),
        F.coalesce(F.col("_since") <= F.col("frame_id"), F.lit(False)).alias("cascade"),
    )
    cells = cells.groupBy("stream_id", "frame_id").applyInPandas(whole_frame, CELLS).withColumn("frame", F.struct("stream_id", "frame_id"))
    for s in "ab":
        cells = spatial.median(cells.withColumn(f"pre_{s}", P.below_confidence(F.col(s), params.confidence)), f"pre_{s}", 5)
    for i in range(params.channels):
        cells = spatial.blur(cells.withColumn(f"s{i}", F.col(f"c{i}")), f"s{i}")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        return compare_frame(df, params.confidence, params.channels)

    frames = cells.drop("frame").groupBy("stream_id", "frame_id").applyInPandas(run, ", ".join(f"{c} long" for c in COUNTS) + ", fault boolean, foreground boolean")
    no = F.lit(False)
    out = frames.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), F.coalesce(F.max("fault"), no).alias("integer_fault"), F.coalesce(F.max("foreground"), no).alias("_on"))
    same = (F.col("prefill_differ") == 0) & (F.col("refined_differ") == 0) & (F.col("composite_differ") == 0)
    kind = F.when(~F.col("_on"), "DEGENERATE").when(same, "IDENTICAL").when((F.col("unexplained") == 0) & ~F.col("integer_fault"), "FLOAT-BOUNDARY").otherwise("DIVERGED")
    return out.select(*COUNTS, "integer_fault", kind.alias("verdict"))
