"""The background model over a stream of frames: the state of a block of pixels is kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridfold.operators.mixture import RESULT, Block, block_of
from gridfold.params import Params


def fold_stream(pixels: DataFrame, params: Params = Params(), update: float = -1.0, rows: int = 16) -> DataFrame:
    """As `mixture.fold`, for a streaming DataFrame, in append mode.

    Frames within a batch are taken by number. A frame that comes in a later batch than one of a
    higher number is folded when it comes: nothing is dropped. State: about 100 bytes a pixel.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        block = Block.load(held.get[0], params) if held.exists else Block(params)
        out = block.fold(pd.concat(list(parts)), update)
        held.update((block.dump(),))
        yield out

    keyed = pixels.withColumn("block", block_of(params, rows)).groupBy("stream_id", "block")
    return keyed.applyInPandasWithState(run, RESULT, "data binary", "append", GroupStateTimeout.NoTimeout)
