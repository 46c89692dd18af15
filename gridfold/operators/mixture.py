"""The background model: a fold of each pixel's frames into a mixture of Gaussians.

A block of pixels is a group; its frames are folded with numpy over all pixels of the block at
once, in single precision and in the order that the model prescribes.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.params import NEIGHBOURS, PLACE_HASH, PROPAGATION, Params

f32 = np.float32
EPSILON = f32(1.1920929e-07)


@dataclass
class State:
    """Mixtures of P pixels: weights and variances (K, P), means (K, C, P), modes in use (P)."""

    pixels: int
    params: Params = field(default_factory=Params)

    def __post_init__(self) -> None:
        k, c, p = self.params.modes, self.params.channels, self.pixels
        self.w, self.v = np.zeros((k, p), f32), np.zeros((k, p), f32)
        self.m, self.n = np.zeros((k, c, p), f32), np.zeros(p, np.int32)
        self.alpha = np.full(p, 0.5, f32)
        self.frames = np.zeros(p, np.int64)

    def rate(self, update: float) -> np.ndarray:
        if update >= 0:  # never on the first frame
            return np.where(self.frames > 1, f32(update), f32(1 / min(2, self.params.history)))
        return (1.0 / np.minimum(2 * self.frames, self.params.history)).astype(f32)

    def _up(self, at: np.ndarray, i: int) -> None:
        """Exchange modes i and i - 1 of some pixels."""
        for x in (self.w, self.v, self.m):
            held = x[i - 1][..., at].copy()
            x[i - 1][..., at] = x[i][..., at]
            x[i][..., at] = held

    def _using(self, ids: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
        """Those of some pixels that have a mode k."""
        return ids[n[ids] > k]

    def step(self, x: np.ndarray, update: float = -1.0, on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(mask, background probability) after one frame x (C, P) of the pixels `on` (all).

        Each mode is worked on for the pixels that have it, and compared for those without a match.
        """
        p = self.params
        ids = np.arange(self.pixels) if on is None else np.flatnonzero(on)
        self.frames[ids] += 1
        with np.errstate(divide="ignore"):
            base = self.rate(update)
        alpha = self.alpha.copy() if p.adaptive else base
        one, prune = f32(1) - alpha, (-alpha * f32(p.complexity)).astype(f32)
        x = x.astype(f32)
        total, found = np.zeros(self.pixels, f32), np.zeros(self.pixels, f32)
        back, fit, n = np.zeros(self.pixels, bool), np.zeros(self.pixels, bool), self.n.copy()
        for k in range(p.modes):
            live = self._using(ids, n, k)
            if not len(live):
                break
            at = slice(None) if len(live) == self.pixels else live
            old, v, m = self.w[k, at], self.v[k, at], self.m[k][:, at]
            w, free, rate = one[at] * old + prune[at], ~fit[at], alpha[at]
            d = m - x[:, at]
            d2 = d[0] * d[0]
            for c in range(1, p.channels):
                d2 = d2 + d[c] * d[c]
            near = free & (d2 < f32(p.background_threshold) * v)
            found[at] = np.where(near, found[at] + old, found[at])
            back[at] |= near & (total[at] < f32(p.background_ratio))
            close = free & (d2 < f32(p.generation_threshold) * v)
            w = np.where(close, w + rate, w)
            with np.errstate(divide="ignore", invalid="ignore"):
                rate = np.where(close, rate / w, f32(0))
                self.m[k][:, at] = np.where(close, m - rate * d, m)
            self.v[k, at] = np.where(close, np.clip(v + rate * (d2 - v), f32(p.var_min), f32(p.var_max)), v)
            fit[at] |= close
            if k:
                place, own = np.full(len(live), k), np.flatnonzero(close)
                hit = live[own]
                for i in range(k, 0, -1):
                    up = ~(w[own] < self.w[i - 1, hit])
                    own, hit = own[up], hit[up]
                    if not len(hit):
                        break
                    self._up(hit, i)
                    place[own] = i - 1
            gone = np.flatnonzero(w < -prune[at])
            w[gone] = 0
            n[live[gone]] -= 1
            if k:
                self.w[place, live] = w
            else:
                self.w[0, at] = w
            total[at] += w
        with np.errstate(divide="ignore"):
            scale = np.where(np.abs(total) > EPSILON, f32(1) / total, f32(0)).astype(f32)
        for k in range(p.modes):
            live = self._using(ids, n, k)
            if not len(live):
                break
            at = slice(None) if len(live) == self.pixels else live
            self.w[k, at] *= scale[at]
        new = ids[~fit[ids] & (alpha[ids] > 0)]
        slot = np.minimum(n[new], p.modes - 1)
        n[new] = np.minimum(n[new] + 1, p.modes)
        for k in range(p.modes - 1):
            live = new[k < n[new] - 1]
            self.w[k, live] *= one[live]
        self.w[slot, new] = np.where(n[new] == 1, f32(1), alpha[new])
        self.v[slot, new] = f32(p.var_init)
        self.m[slot, :, new] = x[:, new].T
        moving = new
        for i in range(p.modes - 1, 0, -1):
            deep = n[moving] > i
            here = deep & ~(alpha[moving] < self.w[i - 1, moving])
            self._up(moving[here], i)
            moving = moving[here | ~deep]
        self.n = n
        if p.adaptive:
            changed = np.where(back, np.minimum(alpha * f32(1.02), base), np.maximum(alpha * f32(0.98), base / f32(8))).astype(f32)
            self.alpha[ids] = changed[ids]
        mask = np.where(back, 0, 255)
        if p.detect_shadows:
            mask = np.where(~back & self.shadow(x), 127, mask)
        return mask, found

    def shadow(self, x: np.ndarray) -> np.ndarray:
        """Pixels that are a darker version of a background mode."""
        p = self.params
        out, done, total = np.zeros(self.pixels, bool), np.zeros(self.pixels, bool), np.zeros(self.pixels, f32)
        for k in range(p.modes):
            live = ~done & (k < self.n)
            num, den = np.zeros(self.pixels, f32), np.zeros(self.pixels, f32)
            for c in range(p.channels):
                num, den = num + x[c] * self.m[k, c], den + self.m[k, c] * self.m[k, c]
            done |= live & (den == 0)
            live &= den != 0
            with np.errstate(divide="ignore", invalid="ignore"):
                a = (num / den).astype(f32)
            d2 = np.zeros(self.pixels, f32)
            for c in range(p.channels):
                d2 = d2 + (a * self.m[k, c] - x[c]) * (a * self.m[k, c] - x[c])
            dark = live & (num <= den) & (num >= f32(p.shadow_ratio) * den) & (d2 < f32(p.background_threshold) * self.v[k] * a * a)
            out |= dark
            total = np.where(live, total + self.w[k], total)
            done |= dark | (live & (total > f32(p.background_ratio)))
        return out

    def background(self) -> np.ndarray:
        """The learned background (C, P), bytes: the mean of the modes that make it up."""
        p = self.params
        before, weight = np.zeros(self.pixels, f32), np.zeros(self.pixels, f32)
        mean = np.zeros((p.channels, self.pixels), f32)
        for k in range(p.modes):
            use = (k < self.n) & (before < f32(p.background_ratio))
            weight = weight + np.where(use, self.w[k], f32(0))
            mean = mean + np.where(use, self.w[k], f32(0)) * self.m[k]
            before = before + np.where(k < self.n, self.w[k], f32(0))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(weight > 0, mean / weight, 0)
        return np.clip(np.rint(out), 0, 255).astype(np.int32)


class Block:
    """The pixels of a block, their places in a `State`, and its fold; grows with new pixels."""

    ARRAYS = ("w", "v", "m", "n", "alpha", "frames")

    def __init__(self, params: Params):
        self.params, self.state = params, State(0, params)
        self.keys = np.zeros(0, np.int64)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, keys=self.keys, **{a: getattr(self.state, a) for a in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, params: Params) -> Block:
        out, held = cls(params), np.load(io.BytesIO(data))
        out.keys, out.state = held["keys"], State(len(held["keys"]), params)
        for a in cls.ARRAYS:
            setattr(out.state, a, held[a])
        return out

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places of pixels; new ones come after those known."""
        new = np.setdiff1d(keys, self.keys)
        if len(new):
            fresh = State(len(new), self.params)
            for a in self.ARRAYS:
                setattr(self.state, a, np.concatenate([getattr(self.state, a), getattr(fresh, a)], axis=-1))
            self.keys = np.concatenate([self.keys, new])
            self.state.pixels = len(self.keys)
        order = np.argsort(self.keys)
        return order[np.searchsorted(self.keys, keys, sorter=order)]

    def pass_on(self, mask: np.ndarray, on: np.ndarray) -> None:
        """Some background pixels seed their first mode, at a tenth of its weight, in the last slot of
        a neighbour. All is read before anything is written; of two writers the later by row stays."""
        s = self.state
        y, x = self.keys >> 32, self.keys & 0xFFFFFFFF
        h = (y * PLACE_HASH[0] + x * PLACE_HASH[1]).astype(np.int32)
        from_ = np.flatnonzero(on & (mask == 0) & (s.n > 0) & ((h & 0x7FFFFFFF) % PROPAGATION == 0))
        from_ = from_[np.argsort(self.keys[from_])]
        step = np.array(NEIGHBOURS)[(h[from_] >> 4) & 7]
        ny, nx = y[from_] + step[:, 0], x[from_] + step[:, 1]
        key = np.where((ny >= 0) & (nx >= 0), ny << 32 | nx, -1)
        inside = np.isin(key, self.keys)
        from_, to = from_[inside], self.places(key[inside])
        last = len(to) - 1 - np.unique(to[::-1], return_index=True)[1]
        from_, to = from_[last], to[last]
        slot = np.minimum(s.n[to], self.params.modes - 1)
        w, v, m = s.w[0, from_] * f32(0.1), s.v[0, from_], s.m[0][:, from_].T
        s.w[slot, to], s.v[slot, to], s.m[slot, :, to] = w, v, m
        s.n[to] = np.minimum(s.n[to] + 1, self.params.modes)

    def fold(self, df: pd.DataFrame, update: float, snapshot: bool = False) -> pd.DataFrame:
        df = df.sort_values(["frame_id", "y", "x"], kind="stable")
        place = self.places(df["y"].to_numpy(np.int64) << 32 | df["x"].to_numpy(np.int64))
        state, c = self.state, df[["c0", "c1", "c2"]].to_numpy(f32)
        mask, prob, modes = np.zeros(len(df), np.int32), np.zeros(len(df)), np.zeros(len(df), np.int32)
        held: dict[str, list[np.ndarray]] = {"w": [], "v": [], "m": []}
        edge = np.flatnonzero(np.diff(df["frame_id"].to_numpy(), prepend=np.int64(-(1 << 62))))
        for lo, hi in zip(edge, np.append(edge[1:], len(df))):
            at = place[lo:hi]
            x, on = np.zeros((3, state.pixels), f32), np.zeros(state.pixels, bool)
            x[:, at], on[at] = c[lo:hi].T, True
            m, b = state.step(x[: self.params.channels], update, on)
            if self.params.propagate:
                self.pass_on(m, on)
            mask[lo:hi], prob[lo:hi], modes[lo:hi] = m[at], b[at], state.n[at]
            if snapshot:
                held["w"] += list(state.w[:, at].T)
                held["v"] += list(state.v[:, at].T)
                held["m"] += list(state.m[:, :, at].reshape(-1, len(at)).T)
        out = df[["stream_id", "frame_id", "y", "x"]].assign(mask=mask, bg_prob=prob, n=modes)
        return out.assign(**held) if snapshot else out


RESULT = "stream_id string, frame_id long, y int, x int, mask int, bg_prob double, n int"
SNAPSHOT = f"{RESULT}, w array<float>, v array<float>, m array<float>"
BACKGROUND = "stream_id string, y int, x int, c0 int, c1 int, c2 int"


def block_of(params: Params, rows: int) -> Column:
    """Blocks of `rows` lines; a whole frame where modes pass from pixel to pixel."""
    return F.lit(0).alias("block") if params.propagate else F.expr(f"y div {int(rows)}").alias("block")


def fold(pixels: DataFrame, params: Params = Params(), update: float = -1.0, rows: int = 8, final: bool = False, snapshot: bool = False) -> DataFrame:
    """Mask, background probability and modes in use of every pixel and frame (or, if `final`,
    the learned background of every pixel; if `snapshot`, with the weights, variances and means,
    mode by mode, after each frame).

    Frames of a pixel are taken by number; a filter on frames belongs after the fold, which has
    to see all of them. One shuffle by stream and block of `rows` lines; a task reads a block's
    frames in order and holds its state and a few frames at a time, however long the stream.
    Only where modes pass from pixel to pixel are all frames of a stream held.
    """
    schema = BACKGROUND if final else SNAPSHOT if snapshot else RESULT

    def learned(stream: str, block: Block) -> pd.DataFrame:
        b = block.state.background()
        c = {f"c{i}": b[min(i, len(b) - 1)] for i in range(3)}
        return pd.DataFrame({"stream_id": stream, "y": block.keys >> 32, "x": block.keys & 0xFFFFFFFF, **c})

    def whole(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        block = Block(params)
        out = block.fold(df, update, snapshot)
        return learned(key[0], block) if final else out

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key, block = None, None, Block(params)

        def done(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if len(df):
                out = block.fold(df, update, snapshot)
                if not final:
                    yield out

        for df in batches:
            df = df if held is None else pd.concat([held, df], ignore_index=True)
            change = (df["block"].diff().fillna(0) != 0) | (df["stream_id"] != df["stream_id"].shift(fill_value=df["stream_id"].iloc[0] if len(df) else None))
            parts = np.split(np.arange(len(df)), np.flatnonzero(change.to_numpy()))
            for i, rows in enumerate(parts):
                part = df.iloc[rows]
                if not len(part):
                    continue
                own = (part["stream_id"].iloc[0], part["block"].iloc[0])
                if key is not None and own != key:
                    if final:
                        yield learned(key[0], block)
                    block = Block(params)
                key = own
                if i < len(parts) - 1:
                    yield from done(part)
                else:  # the last frame may go on in the next batch
                    last = part["frame_id"] == part["frame_id"].iloc[-1]
                    yield from done(part[~last])
                    held = part[last]
        if held is not None:
            yield from done(held)
            if final:
                yield learned(key[0], block)

    dealt = pixels.withColumn("block", block_of(params, rows))
    if params.propagate:
        return dealt.groupBy("stream_id", "block").applyInPandas(whole, schema)
    dealt = dealt.select("stream_id", "block", "frame_id", "y", "x", "c0", "c1", "c2")
    # a given number, as small rows that take long to fold would else be coalesced into few tasks
    tasks = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "stream_id", "block").sortWithinPartitions("stream_id", "block", "frame_id", "y", "x").mapInPandas(ordered, schema)
