"""Grids from tables: 8 x 8 frames from vectors, pixel series from events."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.operators import kernels
from gridfold.operators.planes import FRAMES

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, e, grey, m, prob): a frame of 64 cells for each vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("at", "e"))
    return e.select(
        "frame",
        F.expr("cast(at div 8 as int)").alias("y"),
        F.expr("cast(at % 8 as int)").alias("x"),
        F.col("e").cast("double").alias("e"),
        F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("e").cast("double") * 256 + 128))).cast("int").alias("grey"),
        F.when(F.col("e") > 0, 255).otherwise(0).alias("m"),
        (F.col("e").cast("double") + 0.5).cast("float").alias("prob"),
    )


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, frame_id, y, x, c0, c1, c2): a pixel for each user, a frame for each of its events."""
    e = table(spark, sf_dir, "events")
    n = F.expr("row_number() over (partition by user_id order by ts, event_id)")
    return e.select(
        F.lit("events").alias("stream_id"), n.cast("long").alias("frame_id"),
        F.expr("cast(user_id div 15 as int)").alias("y"), F.expr("cast(user_id % 15 as int)").alias("x"),
        (F.floor(F.col("value") / 100) * 40).cast("int").alias("c0"), F.lit(0).alias("c1"), F.lit(0).alias("c2"),
    )


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, frame_id, y, x, c0, c1, c2): the frames of `vector_grid` as a stream of a few
    blue-green-red colours, numbered from 1."""
    g = vector_grid(spark, sf_dir)
    level = F.expr("grey div 40").cast("int")
    n = F.expr("row_number() over (partition by y, x order by frame)")
    return g.select(F.lit("vectors").alias("stream_id"), n.cast("long").alias("frame_id"), "y", "x", (level * 40).alias("c0"), (level * 30).alias("c1"), ((F.col("y") + F.col("x")) * 9).alias("c2"))


def netpbm_frames(spark: SparkSession, path: str, stream: str = "files", pattern: str = r"(\d+)\.p[gp]m$") -> DataFrame:
    """FRAMES from binary grey or colour maps (P5, P6) of 8 bits; the number in a file's name is
    its frame. Comments in a header are skipped, other kinds and depths are errors. Truth and
    regions are read the same way; `pixels_of` makes cells of them."""
    files = spark.read.format("binaryFile").load(path)
    number = F.regexp_extract("path", pattern, 1)

    def decode(batches):
        for b in batches:
            rows = [(stream, n, *netpbm(raw)) for n, raw in zip(b["frame_id"], b["content"])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FRAMES.split(", ")])

    return files.where(number != "").select(number.cast("long").alias("frame_id"), "content").mapInPandas(decode, FRAMES)


def netpbm(raw: bytes) -> tuple[int, int, int, bytes]:
    """(height, width, channels, data) of one binary map."""
    header = re.match(rb"(P[56])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s", raw)
    if not header or int(header[4]) > 255:
        raise ValueError("not a binary map of 8 bits")
    w, h, c = int(header[2]), int(header[3]), 3 if header[1] == b"P6" else 1
    data = raw[header.end() : header.end() + w * h * c]
    if len(data) < w * h * c:
        raise ValueError("a map that ends early")
    return h, w, c, data


def window(frames: DataFrame, first: int, count: int) -> DataFrame:
    """`count` FRAMES from number `first` on, numbered from 1; without the first it is an error."""
    if frames.where(F.col("frame_id") == first).isEmpty():
        raise ValueError(f"no frame {first}")
    return frames.where(F.col("frame_id").between(first, first + count - 1)).withColumn("frame_id", F.col("frame_id") - first + 1)


def resized(frames: DataFrame, height: int, width: int) -> DataFrame:
    """FRAMES of another size, by bilinear interpolation, in batches of whole frames."""

    def run(batches):
        for b in batches:
            out = []
            for h, w, c, data in zip(b["height"], b["width"], b["channels"], b["data"]):
                planes = np.frombuffer(data, np.uint8).reshape(h, w, c)
                out.append(np.stack([kernels.resized(planes[:, :, i], height, width) for i in range(c)], axis=2).astype(np.uint8).tobytes())
            yield b.assign(height=height, width=width, data=out)

    return frames.mapInPandas(run, FRAMES)


def frames_of(pixels: DataFrame) -> DataFrame:
    """FRAMES of complete grids of cells (stream_id, frame_id, y, x, c0, c1, c2) of bytes: the
    inverse of `pixels_of`. One shuffle by frame, which a task holds as a whole."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        h, w = int(df["y"].max()) + 1, int(df["x"].max()) + 1
        if len(df) != h * w:
            raise ValueError("a frame that isn't a complete grid")
        planes = np.zeros((h, w, 3), np.uint8)
        planes[df["y"], df["x"]] = df[["c0", "c1", "c2"]]
        return df.iloc[:1][["stream_id", "frame_id"]].assign(height=h, width=w, channels=3, data=[planes.tobytes()])

    return pixels.select("stream_id", "frame_id", "y", "x", "c0", "c1", "c2").groupBy("stream_id", "frame_id").applyInPandas(run, FRAMES)


def pixels_of(frames: DataFrame) -> DataFrame:
    """(stream_id, frame_id, y, x, c0, c1, c2) of FRAMES; grey ones have their value thrice."""

    def run(batches):
        for b in batches:
            for s, n, h, w, c, data in zip(*(b[x.split()[0]] for x in FRAMES.split(", "))):
                y, x = np.indices((h, w), np.int32).reshape(2, -1)
                v = np.frombuffer(data, np.uint8).reshape(h * w, c).astype(np.int32)
                yield pd.DataFrame({"stream_id": s, "frame_id": n, "y": y, "x": x, **{f"c{i}": v[:, min(i, c - 1)] for i in range(3)}})

    return frames.mapInPandas(run, "stream_id string, frame_id long, y int, x int, c0 int, c1 int, c2 int")


def traffic(spark: SparkSession, frames: int, height: int, width: int, cars: int = 4) -> DataFrame:
    """(stream_id, frame_id, y, x, c0, c1, c2): a grainy road on which `cars` rectangles drive, each
    at its own speed; a function of frame and place, so any task can make any part of it."""
    cells = spark.range(0, frames * height * width, numPartitions=max(frames * height * width // 500_000, spark.sparkContext.defaultParallelism))
    t, y, x = (F.expr(e) for e in (f"id div {height * width} + 1", f"cast(id div {width} % {height} as int)", f"cast(id % {width} as int)"))
    cells = cells.select(t.alias("frame_id"), y.alias("y"), x.alias("x"))
    value = 70 + F.pmod(F.xxhash64("y", "x"), F.lit(30))
    lane, length = height // cars, max(width // 8, 2)
    for i in range(cars):
        at = (F.col("frame_id") * (i + 2) * max(width // 160, 1) + i * width // cars) % (width + length) - length
        on = F.col("y").between(i * lane + lane // 4, i * lane + lane * 3 // 4) & F.col("x").between(at, at + length - 1)
        value = F.when(on, 140 + 25 * (i % 4)).otherwise(value)
    grain = lambda c: F.pmod(F.xxhash64("frame_id", "y", "x", F.lit(c)), F.lit(5)) - 2
    return cells.select(F.lit("traffic").alias("stream_id"), "frame_id", "y", "x", *((value + 5 * c + grain(c)).cast("int").alias(f"c{c}") for c in range(3)))


def parse_records(lines: DataFrame) -> DataFrame:
    """(header, name, milliseconds) of benchmark lines such as "name   12.34 ms". A line that ends
    in a colon heads those after it; the order is that of `line` if there is such a column, else
    there is no header."""
    r = r"^\s*(\S.*?)\s+([0-9]+(?:\.[0-9]+)?)\s*ms"
    header = F.lit(None).cast("string")
    if "line" in lines.columns:
        own = F.when(F.col("value").rlike(r":\s*$"), F.regexp_extract("value", r"^\s*(.*?)\s*:\s*$", 1))
        header = F.last(own, ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("line"))
    lines = lines.withColumn("header", header).where(F.col("value").rlike(r))
    return lines.select("header", F.regexp_extract("value", r, 1).alias("name"), F.regexp_extract("value", r, 2).cast("double").alias("milliseconds"))
