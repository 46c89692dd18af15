"""The model, the mask chain and the blur on frames as binary rows: what `mixture`, `spatial` and
`shapes` do on a row for each cell, for frames of the size of a picture.

Frames are `carriers.FRAMES`: bytes of the channels of each cell, line by line. A frame without
data is left out; a null stream or number is a stream or a frame of its own. Columns other than
those of FRAMES aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.operators import kernels, shapes
from gridfold.operators.mixture import RESULT, State
from gridfold.params import Params

FRAMES = "stream_id string, frame_id long, height int, width int, channels int, data binary"
NAMES = [f.split()[0] for f in FRAMES.split(", ")]
#: `mask`: bytes; `below`: 255 where the background's probability is under the confidence; `bg_prob`:
#: single precision; `n`: modes in use, bytes.
FOLDED = f"{FRAMES}, strip int, mask binary, below binary, bg_prob binary, n binary"
FINISHED = f"{FRAMES}, mask binary, refined binary"


def strips(frames: DataFrame, cells: int = 4096) -> DataFrame:
    """FRAMES and `strip`: each frame cut into runs of `cells` cells, without a copy of its bytes
    (an expression over a binary column would copy the frame for each run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, c, data in zip(range(len(b)), b["channels"].to_pylist(), b["data"]):
                raw = data.as_buffer()
                edge = np.append(np.arange(0, raw.size, c * cells), raw.size).astype(np.int32)
                n = len(edge) - 1
                cut = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edge), raw])
                shape = [b.column(j).take(pa.array(np.full(n, i))) for j in range(5)]
                yield pa.RecordBatch.from_arrays([*shape, cut, pa.array(np.arange(n, dtype=np.int32))], names=[*NAMES, "strip"])

    return frames.where("length(data) > 0").select(*NAMES).mapInArrow(run, f"{FRAMES}, strip int")


def fold(frames: DataFrame, params: Params = Params(), update: float = -1.0, colour: str = "ycrcb", cells: int = 4096, prob: bool = True) -> DataFrame:
    """FOLDED: the model's results for each strip of each frame, `bg_prob` only if `prob`.

    Frames are taken by number. One shuffle by stream and strip, strips of a stream in turn over
    the tasks; a task reads its strips one after another, frame by frame, and holds one strip's
    state. Spark bounds what a task holds of the frames (64 MB a batch). All frames of a stream
    have one size.
    """
    if params.propagate:
        raise ValueError("modes that pass from cell to cell need mixture.fold")
    if colour not in ("ycrcb", "bgr"):
        raise ValueError(f"no colour space {colour}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, State(0, params)
        for b in batches:
            out = {c: [] for c in ("mask", "below", "bg_prob", "n")}
            for stream, strip, shape, c, data in zip(b["stream_id"], b["strip"], zip(b["height"], b["width"], b["channels"]), b["channels"], b["data"]):
                x = np.frombuffer(data, np.uint8).reshape(-1, c).T[[min(i, c - 1) for i in range(3)]]
                if (stream, strip) != key:
                    key, size, state = (stream, strip), shape, State(x.shape[1], params)
                if shape != size:
                    raise ValueError(f"frames of two sizes in stream {stream}")
                mask, p = state.step((kernels.ycrcb(x) if colour == "ycrcb" else x)[: params.channels], update)
                out["mask"].append(mask.astype(np.uint8).tobytes())
                out["below"].append(np.where(p < np.float32(params.confidence), 255, 0).astype(np.uint8).tobytes())
                out["bg_prob"].append(p.tobytes() if prob else None)
                out["n"].append(state.n.astype(np.uint8).tobytes())
            yield b.assign(**out)

    cut = strips(frames, cells)
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartitionById(tasks, F.expr(f"cast(pmod(xxhash64(stream_id) + strip, {tasks}) as int)"))
    # the whole of a strip's frames follow one another; others of its task come before or after
    return dealt.sortWithinPartitions("stream_id", "strip", "frame_id").mapInPandas(run, FOLDED)


def finish(folded: DataFrame, close: int = 0) -> DataFrame:
    """FINISHED: the refined mask of each frame, by confidence, and in `data` the frame with its
    background blurred. One shuffle by frame; a task holds a whole frame."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("strip", kind="stable")
        h, w, c = (int(df[x].iloc[0]) for x in ("height", "width", "channels"))
        grid = lambda x, *more: np.frombuffer(b"".join(df[x]), np.uint8).reshape(h, w, *more)
        m = shapes.fill_holes(kernels.closed(kernels.majority(grid("below")), close))
        out = df.iloc[:1][["stream_id", "frame_id", "height", "width", "channels"]]
        data = np.where(m[:, :, None] != 0, grid("data", c), _blurred(grid("data", c)))
        return out.assign(data=[data.tobytes()], mask=[b"".join(df["mask"])], refined=[m.astype(np.uint8).tobytes()])

    few = folded.select("stream_id", "frame_id", "height", "width", "channels", "strip", "data", "mask", "below")
    return few.groupBy("stream_id", "frame_id").applyInPandas(run, FINISHED)


def blur_background(frames: DataFrame, params: Params = Params(), update: float = -1.0, colour: str = "ycrcb", close: int = 0) -> DataFrame:
    """FINISHED of blue-green-red FRAMES: colour, fold, refinement, blur and composite."""
    return finish(fold(frames, params, update, colour, prob=False), close)


def _blurred(planes: np.ndarray) -> np.ndarray:
    return np.stack([kernels.blurred(planes[:, :, i]) for i in range(planes.shape[2])], axis=2).astype(np.uint8)


def blur(frames: DataFrame) -> DataFrame:
    """FRAMES blurred, each on its own, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shaped = zip(b["height"], b["width"], b["channels"], b["data"])
            yield b.assign(data=[_blurred(np.frombuffer(d, np.uint8).reshape(h, w, c)).tobytes() for h, w, c, d in shaped])

    return frames.where("length(data) > 0").select(*NAMES).mapInPandas(run, FRAMES)


def cells_of_folded(folded: DataFrame, cells: int = 4096) -> DataFrame:
    """`mixture.RESULT` of FOLDED (with `bg_prob`) that was made with strips of `cells` cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                mask, n = (np.frombuffer(x, np.uint8).astype(np.int32) for x in (r.mask, r.n))
                at = r.strip * cells + np.arange(len(mask))
                values = {"y": at // r.width, "x": at % r.width, "mask": mask, "bg_prob": np.frombuffer(r.bg_prob, np.float32).astype(float), "n": n}
                yield pd.DataFrame({"stream_id": r.stream_id, "frame_id": r.frame_id, **values})

    return folded.select("stream_id", "frame_id", "width", "strip", "mask", "bg_prob", "n").mapInPandas(run, RESULT)


def cells_of_finished(finished: DataFrame) -> DataFrame:
    """(stream_id, frame_id, y, x, mask, refined, b, g, r) of FINISHED; a grey frame's value thrice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for r in f.itertuples():
                mask, refined = (np.frombuffer(x, np.uint8).astype(np.int32) for x in (r.mask, r.refined))
                at, data = np.arange(len(mask)), np.frombuffer(r.data, np.uint8).reshape(-1, r.channels).astype(np.int32)
                values = {"y": at // r.width, "x": at % r.width, "mask": mask, "refined": refined, **{c: data[:, min(i, r.channels - 1)] for i, c in enumerate("bgr")}}
                yield pd.DataFrame({"stream_id": r.stream_id, "frame_id": r.frame_id, **values})

    return finished.mapInPandas(run, "stream_id string, frame_id long, y int, x int, mask int, refined int, b int, g int, r int")
