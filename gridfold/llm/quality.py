"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes a bag of terms: words (hashed), shapes of words ("Aa," "A!!" "|") and steps of
its share of repeated words. TF-IDF weights and a truncated SVD, fitted on a bounded sample of labelled rows,
make latent vectors; the labelled vectors are broadcast, the exact cosines of every document
with all of them come from blocked matrix products, and the nearest vote with their similarity
as weight.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.llm import textvec as V
from gridfold.llm.common import whole_text

#: Labelled rows in the sample at most; the broadcast holds SAMPLE x RANK floats.
SAMPLE = 4096
RANK = 48
NEIGHBOURS = 25
#: Cosines that differ by less are equal: they may be rounded otherwise in another block.
TIE = 1e-5
THRESHOLD = 0.7
WORD_TERMS, SHAPE_TERMS = 2048, 1024
TERMS = WORD_TERMS + SHAPE_TERMS
#: Length of the shapes' part of a vector; that of the words has length 1.
SHAPE_WEIGHT = 1.0
CLASSES = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)


def terms_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted term numbers and their counts."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    found: Counter[int] = Counter()
    for w, n in Counter(words).items():
        found[zlib.crc32(w.lower()) % WORD_TERMS] += n
    for w, n in Counter(raw.translate(CLASSES).split()).items():
        s = RUNS.sub(rb"\1\1", w)
        s = s.replace(b"aa", b"a").replace(b"AA", b"A")
        found[WORD_TERMS + zlib.crc32(b"s" + s) % SHAPE_TERMS] += n
    if words:
        again = sum(map(eq, words, words[1:])) / len(words)
        step = min(8, int(again * 40))
        found[WORD_TERMS + zlib.crc32(b"again%d" % step) % SHAPE_TERMS] += len(words) if step else 0
        found[WORD_TERMS + zlib.crc32(b"empty") % SHAPE_TERMS] += 0
    else:
        found[WORD_TERMS + zlib.crc32(b"empty") % SHAPE_TERMS] += 1
    keys = np.array(sorted(k for k, v in found.items() if v), np.int32)
    return keys, np.array([found[int(k)] for k in keys], np.float32)


@dataclass
class Model:
    weights: np.ndarray  # TERMS: idf
    axes: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # sample x RANK, unit length
    labels: np.ndarray  # sample
    neighbours: int
    prior: float
    votes: np.ndarray  # sample: rows of its class for each one sampled

    def matrix(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return weigh(bags, self.weights)

    def scores(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(bags), self.prior)
        x = unit(self.matrix(bags) @ self.axes)
        near = x @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        # all that are as near as the last neighbour vote: no tie is broken by places
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        w = np.where(near >= last - TIE, np.maximum(near, 0), 0)
        w *= w
        w *= w
        total = w @ self.votes
        return np.where(total > 1e-12, np.round(w @ (self.votes * self.labels) / np.maximum(total, 1e-12), 6), self.prior)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weigh(bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Rows of TF-IDF; words and shapes each of a length of their own."""
    x = np.zeros((len(bags), TERMS), np.float32)
    for row, (k, v) in zip(x, bags):
        row[k] = np.log1p(v) * idf[k]
        shapes = k >= WORD_TERMS
        row[k[shapes]] = np.sqrt(v[shapes]) * idf[k[shapes]]
    x[:, :WORD_TERMS] = unit(x[:, :WORD_TERMS])
    x[:, WORD_TERMS:] = unit(x[:, WORD_TERMS:]) * SHAPE_WEIGHT
    return x


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS, per_class: tuple[float, float] = (1.0, 1.0)) -> Model:
    """TF-IDF weights and the leading right singular vectors by subspace iteration."""
    n, votes = len(bags), np.where(labels == 1, per_class[1], per_class[0])
    if not n:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, neighbours, 0.5, votes)
    df = np.bincount(np.concatenate([k for k, _ in bags]), minlength=TERMS)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1
    x = weigh(bags, idf)
    rank = min(rank, n, TERMS)
    q = np.random.default_rng(7).standard_normal((TERMS, min(rank + 8, n))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt.T)[:, :rank].astype(np.float32)
    return Model(idf, axes, unit(x @ axes).astype(np.float32), labels, neighbours, float(np.average(labels, weights=votes)), votes)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` rows of both classes, chosen by a hash of the id.

    Each class gets half of the sample, or what the other leaves; votes are weighted back to the
    classes' shares among all labels, whatever the sample's mix. Held-out ids, null labels
    and null ids are left out; of repeated ids one label (the smallest) and one text count.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # each class in order of the hash; what follows reads at most 2 x sample ids
    few = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    ids = {q: [r[0] for r in part.select("doc_id").collect()] for q, part in enumerate(few)}
    n0 = min(len(ids[0]), max(sample // 2, sample - len(ids[1])))
    chosen = [(i, q) for q, n in ((0, n0), (1, sample - n0)) for i in ids[q][:n]]
    total = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    taken = {q: sum(x == q for _, x in chosen) for q in (0, 1)}
    per_class = tuple(total.get(q, 0) / max(taken[q], 1) for q in (0, 1))
    if not chosen:
        return fit([], np.zeros(0))
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("_q", T.IntegerType())])))
    rows = docs.select("doc_id", whole_text(docs).alias("_text")).join(wanted, "doc_id").select("doc_id", "_q", "_text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms_of(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k.tobytes() for k, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["doc_id", "q", "k", "v"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("q", T.IntegerType()), T.StructField("k", T.BinaryType()), T.StructField("v", T.BinaryType())])
    got = {r[0]: r for r in sorted(rows.mapInArrow(bags, schema).collect(), key=lambda r: (r[0], bytes(r[2]), bytes(r[3])))}
    got = [got[i] for i in sorted(got)]
    return fit([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in got], np.array([r[1] for r in got], np.float64), per_class=per_class)


def score_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, block: int = 256) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, score (0 to 1) and predicted (0 or 1).

    Null and empty texts are scored as the empty bag, very long ones by all their words. Without
    any labelled row the score is 0.5. Of neighbours as near as the last one all vote, so equal
    texts and repeated rows score alike. Extra columns are ignored unless kept. Documents are
    never shuffled; `block` of them meet the labelled vectors at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    n, names = len(keep), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            parts = []
            for i in range(0, b.num_rows, block):
                parts.append(m.scores([terms_of(x.as_py()) for x in b.column(n).slice(i, block)]))
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names)

    return docs.select(*keep, whole_text(docs).alias("_text")).mapInArrow(V.lean(run), schema)
