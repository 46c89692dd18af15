"""Benchmark decontamination by greedy string tiling.

Seeds are runs of `min_match` words that a document shares with a benchmark item, found with a
rolling Karp-Rabin hash and confirmed word by word. Runs on one diagonal make maximal matches;
the longest match whose words are all free on both sides is marked again and again, whatever
the order in which the item's parts stand. The share of an item's words under tiles is its
coverage, and a document that covers an item far enough is contaminated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.llm.common import Scratch, whole_text
from gridfold.llm.license_scan import TABLE

MIN_MATCH = 5
THRESHOLD = 0.5
#: Bytes of item texts that one pass over the documents holds; larger benchmarks take several.
BLOCK_BYTES = 8 << 20
#: Seeds of a document held at a time.
SEEDS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
FIELDS = "n_tiles long, covered long, coverage double, best_item long, contaminated boolean"


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split()


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2^64) of each run of k ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * BASE + x[i : i + n]
    return out


class Index:
    """Seeds of a block of items: hash -> (item, place)."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k, self.vocab = k, {}
        self.ids, self.names = [], []
        for name, text in sorted(items):
            own = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            if len(own) >= k:
                self.names.append(name)
                self.ids.append(np.array(own, np.int32))
        self.flat = np.concatenate([*self.ids, np.zeros(0, np.int32)])
        self.starts = np.cumsum([0, *map(len, self.ids)])[:-1]
        hashes = [rolling(x, k) for x in self.ids]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.item = np.concatenate([np.full(len(h), i, np.int32) for i, h in enumerate(hashes)])[order] if hashes else np.zeros(0, np.int32)
        self.place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes])[order] if hashes else np.zeros(0, np.int32)

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Maximal matches of at least k words, (item, place in the document less that in the
        item, place in the document, words) in rows, and the document's word numbers.

        Seeds are looked at SEEDS at a time and joined along their diagonals at once, so a phrase
        that recurs in both texts needs no more memory than its matches.
        """
        get = self.vocab.get
        words = words_of(text)
        if len(words) < self.k or not len(self.hashes):
            return None
        doc = np.array([get(w, -1) for w in words], np.int32)
        known = np.concatenate([[0], np.cumsum(doc >= 0)])
        at = np.flatnonzero(known[self.k :] - known[: -self.k] == self.k)
        if not len(at):
            return None
        h = rolling(doc, self.k)[at]
        low = np.searchsorted(self.hashes, h)
        hit = (low < len(self.hashes)) & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == h)
        if not hit.any():
            return None
        at, h, low = at[hit], h[hit], low[hit]
        n = np.searchsorted(self.hashes, h, side="right") - low
        total, found, i = np.cumsum(n), np.zeros((0, 4), np.int64), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, total[i] - n[i] + SEEDS, side="right")))
            m = n[i:j]
            rows = np.repeat(low[i:j] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            begin, item, place = np.repeat(at[i:j], m), self.item[rows], self.place[rows].astype(np.int64)
            same = np.ones(len(begin), bool)
            for x in range(self.k):
                same &= doc[begin + x] == self.flat[self.starts[item] + place + x]
            begin, item, place = begin[same], item[same], place[same]
            seeds = np.stack([item, begin - place, begin, np.full(len(begin), self.k)], axis=1)
            found = joined(np.concatenate([found, seeds]), self.k)
            i = j
        return found, doc

    def tiles(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, tiles, words covered, words) of each item that shares a seed."""
        got = self.matches(text)
        if got is None:
            return []
        found, doc = got
        out = []
        for own in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
            if len(own):
                i = int(own[0, 0])
                out.append((i, *tile(len(doc), len(self.ids[i]), own[:, 1:], self.k), len(self.ids[i])))
        return out


def joined(runs: np.ndarray, k: int) -> np.ndarray:
    """Runs (item, diagonal, begin, words) in order, those that overlap by k - 1 words or more as one."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if not len(runs):
        return runs
    end = runs[:, 2] + runs[:, 3]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1) | (runs[1:, 2] > end[:-1] - k + 1)
    first = np.flatnonzero(new)
    out = runs[first].copy()
    out[:, 3] = end[np.append(first[1:], len(runs)) - 1] - out[:, 2]
    return out


def tile(n_doc: int, n_item: int, runs: np.ndarray, k: int) -> tuple[int, int]:
    """Greedy tiling from maximal matches (diagonal, begin, words); (tiles, words of the item covered).

    Of matches of one length the first in the document, then in the item, is marked first.
    """
    heap = [(-n, d, d - x) for x, d, n in runs.tolist()]
    heapq.heapify(heap)
    doc_free, item_free = np.ones(n_doc, bool), np.ones(n_item, bool)
    tiles = 0
    while heap:
        n, d, p = heapq.heappop(heap)
        free = doc_free[d : d - n] & item_free[p : p - n]
        if free.all():
            doc_free[d : d - n] = item_free[p : p - n] = False
            tiles += 1
            if not item_free.any():
                break
        elif free.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= k:
                    heapq.heappush(heap, (a - b, d + a, p + a))
    return tiles, int((~item_free).sum())


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), min_match: int = MIN_MATCH, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, then those of FIELDS.

    `best_item` is the item of the highest coverage (of equal ones the smallest id; null if no
    seed is shared), `covered` its words under `n_tiles` tiles. Null and empty texts, an empty
    benchmark and items of fewer than `min_match` words give no match. Null item ids and texts
    are ignored; of equal items the smaller id is told, and repeated rows come out alike. Texts
    are compared as wholes. Extra columns are ignored unless kept; a kept one named like one of
    FIELDS is refused. Documents are never shuffled; the benchmark is read in blocks of about
    BLOCK_BYTES (a longer single item is a block), each a pass over the documents whose result is
    written, so that one block is held at a time.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    for name in T._parse_datatype_string(FIELDS).names:
        if name in keep:
            raise ValueError(f"{name} is a column of the result")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("_text", T.StringType()), *T._parse_datatype_string(FIELDS)])
    n, names = len(keep), schema.names
    out = docs.select(*keep, whole_text(docs).alias("_text"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[n + 1 :]))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, min_match)
            for batch in batches:
                rows = []
                earlier = zip(*(batch.column(n + 1 + i).to_pylist() for i in range(5)))
                for text, old in zip(batch.column(n), earlier):
                    best = old if old[0] is not None else (0, 0, 0.0, None, False)
                    for i, tiles, covered, words in index.tiles(text.as_py()):
                        share = covered / words
                        if covered and (best[3] is None or (-share, index.names[i]) < (-best[2], best[3])):
                            best = (tiles, covered, share, index.names[i], share >= threshold)
                    rows.append(best)
                columns = list(zip(*rows)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *(pa.array(x, t) for x, t in zip(columns, types))], names)

        out = out.mapInArrow(run, schema)
        if b < blocks - 1:
            scratch = scratch or Scratch(spark)
            out = scratch.put(out, f"block-{b}")
            scratch.drop(f"block-{b - 1}")
    return out.drop("_text")
