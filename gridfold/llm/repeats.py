"""Removal of long byte strings that occur more than once, by suffix arrays.

1. Winnowing picks an anchor for every window of `length` bytes: the smallest hash of the
   grams in it, the leftmost of equal ones. Equal windows have equal anchors at equal places, so
   they also share a core: the longest string around the anchor that all windows hold that
   begin well before it, or all others. Consecutive windows of one anchor and core make a
   region. Only regions whose core is marked as seen twice, in a bitmap sized by the number of
   bytes, can hold a repeat; they go on as 128-bit digests, without their bytes.
2. Equal regions meet by an aggregation of digests. Where different regions share a core, one
   text's bytes of each go to the core's shard: its suffix array comes from Larsson-Sadakane
   refinement, its common prefixes from Kasai's rule, and windows with a neighbour of `length`
   common bytes are repeats.
3. A core with too many different regions for a shard has several; each sends its distinct
   windows' digests as sorted runs, and binary search in the other runs finds repeats across
   shards.

A text that occurs twice loses everything, so its copies never meet: the very frequent ones
are known to every task (their number is bounded), which reads one row of each in the whole
corpus; of other texts a task looks at one copy only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.llm import textvec as V
from gridfold.llm.common import Scratch, release, whole_text
from gridfold.llm.line_dedup import marked
from gridfold.llm.marks import bitmap, bits_for
from gridfold.llm.textvec import U

LENGTH = 200
GRAM = 32
#: Bytes of a shard; about how many regions of one core in a shard (each has at most
#: 2 * length bytes); longest piece of a text at a time.
SHARD, REGIONS, PIECE = 3 << 20, 2048, 2 << 20
#: Keys that every task may know: more frequent ones than a share of 1 / HOT, so at most so many.
HOT = 50_000
#: Texts that a task remembers, to skip their copies.
RECENT = 200_000
#: Regions that a task remembers to have sent; frequent ones recur soon.
SENT = 20_000
#: Copies of a text from which on one row is told to every task, to stand for all.
COPIES = 1000
_PLACE = U((1 << 24) - 1)


def eights(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The 8 bytes from each place on as a number; zeros follow the end."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8" if big else "<u8", raw.tobytes(), strides=(1,)).astype(U)


def regions(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash of the core) of the regions of all texts, in no order;
    windows keep to a text."""
    wide = length - GRAM + 1
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    x = eights(data)
    with np.errstate(over="ignore"):
        h = x[: len(x) - GRAM + 1] * U(0x9E3779B97F4A7C15)
        for i, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0x27D4EB2F165667C5)):
            h += x[i : i + len(h)] * U(c)
            h ^= h >> U(29)
            h *= U(0xFF51AFD7ED558CCD)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=U)
    rows = -(-len(key) // wide)
    grid = np.full(rows * wide, np.iinfo(U).max, U)
    grid[: len(key)] = key
    grid = grid.reshape(rows, wide)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[:n], left[wide - 1 : wide - 1 + n]) & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = np.flatnonzero(text[:n] == text[length - 1 :])
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    at = at[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (np.diff(ok) != 1) | (at[1:] != at[:-1]) | (text[ok[1:]] != text[ok[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ok)) - 1
    lo, hi, at = ok[first], ok[last], at[first]

    def core(begin: np.ndarray, size: int, seed: int) -> np.ndarray:
        key = np.full(len(begin), seed, U)
        for i in [*range(0, size - GRAM, GRAM), size - GRAM]:
            key = V.mix(key * U(0x9E3779B97F4A7C15) + h[begin + i])
        return key

    half = (length - GRAM) // 2
    before, after = lo <= at - half, hi > at - half
    with np.errstate(over="ignore"):
        keys = core(at[before] - half, half + GRAM, 1), core(at[after], length - half + 1, 2)
    first = np.concatenate([lo[before], np.maximum(lo, at - half + 1)[after]])
    return first, np.concatenate([np.minimum(hi, at - half)[before], hi[after]]), np.concatenate(keys)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes' first `depth` bytes, by Larsson-Sadakane
    refinement: ranks by h bytes give ranks by 2h, and only groups not yet sorted move."""
    n = len(data)
    key = eights(data, big=True)
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.zeros(n + 1, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = group + 1
    h = 8
    while h < depth:
        alone = new & np.append(new[1:], True)
        todo = np.flatnonzero(~alone)
        if not len(todo):
            break
        p = sa[todo]
        key = rank[p] << 32 | rank[np.minimum(p + h, n)]
        order = np.argsort(key, kind="stable")
        key, p = key[order], p[order]
        sa[todo] = p
        split = np.ones(len(todo), bool)
        split[1:] = key[1:] != key[:-1]
        new[todo] = split
        group = np.maximum.accumulate(np.where(split, todo, 0))
        rank[p] = group + 1
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix and the one before it in `sa`, the bytes in common, up to `most`.

    Kasai's rule in text order: where the bytes before both agree, the value is one less than
    that of the place before; elsewhere 8 bytes are compared at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    x = eights(data)
    q = np.arange(n)
    linked = np.zeros(n, bool)
    linked[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (before[:-1] >= 0)
    linked[1:] &= data[q[1:] - 1] == data[np.maximum(before[1:] - 1, 0)]
    value = np.zeros(n, np.int64)
    todo = np.flatnonzero(~linked & (before >= 0))
    at = 0
    limit = most + n  # values of chains run down from their heads, so heads go on beyond `most`
    end = np.append(np.flatnonzero(~linked)[1:], n)
    reach = np.zeros(n, np.int64)
    reach[np.flatnonzero(~linked)] = end - np.flatnonzero(~linked)
    while len(todo) and at < limit:
        a, b = todo + at, before[todo] + at
        inside = (a < n) & (b < n)
        todo, a, b = todo[inside], a[inside], b[inside]
        differ = x[a] ^ x[b]
        same = differ == 0
        low = differ & (~differ + U(1))
        value[todo] = at + np.where(same, 8, np.bitwise_count(np.maximum(low, U(1)) - U(1)).astype(np.int64) // 8)
        at += 8
        todo = todo[same & (at < most + reach[todo])]
    head = np.maximum.accumulate(np.where(linked, -1, q))
    value = np.minimum(np.maximum(value[head] - (q - head), 0), most)
    value = np.minimum(value, np.minimum(n - q, n - before))
    return np.where(before[sa] >= 0, value[sa], 0)


def repeated_windows(contents: list[bytes], length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each content which of its windows occur elsewhere in the shard, and all windows'
    places in the shard in the order of their suffixes."""
    sizes = np.array([len(c) for c in contents])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(contents), np.uint8)
    window = np.ones(len(data), bool)
    for i in range(1, length):
        window[ends - i] = False
    sa = suffix_array(data, length)
    sa = sa[window[sa]]
    full = common_prefixes(data, sa, length) >= length
    hit = np.zeros(len(data), bool)
    hit[sa[full]] = True
    hit[sa[np.flatnonzero(full) - 1]] = True
    return [hit[e - s : e - length + 1] for s, e in zip(sizes, ends)], sa


def runs_of(flags: np.ndarray) -> np.ndarray:
    """Pairs (first, last) of set places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return np.stack([edge[::2], edge[1::2] - 1], axis=1)


#: A distinct window of a shard: its digest, the region that holds it, its place there.
DIGEST = np.dtype([("d", U), ("e", U), ("c1", np.int64), ("c2", np.int64), ("at", np.int32)])


def digests(raw: memoryview, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes of the strings [begin, end), as pairs of longs."""
    found = b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(begins.tolist(), ends.tolist())])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def across(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted run of distinct windows which of them another run holds, by binary search
    of each run in all those before it and, the other way round, in all those behind it."""

    def sweep(order: list[int]) -> None:
        d, e = np.zeros(0, U), np.zeros(0, U)
        for i in order:
            at = np.searchsorted(d, runs[i]["d"])
            look = np.arange(len(at))
            while len(look):
                look = look[at[look] < len(d)]
                look = look[d[at[look]] == runs[i]["d"][look]]
                same = e[at[look]] == runs[i]["e"][look]
                hits[i][look[same]] = True
                look = look[~same]
                at[look] += 1
            d, e = np.insert(d, at, runs[i]["d"]), np.insert(e, at, runs[i]["e"])

    hits = [np.zeros(len(r), bool) for r in runs]
    sweep([*range(len(runs))])
    sweep([*reversed(range(len(runs)))])
    return hits


class Pieces:
    """Batches (t1, t2, text, row) in pieces of texts that are new to the task; a text that
    `owners` knows is read in its owner's row alone."""

    def __init__(self, length: int, owners: dict[tuple[int, int], int]):
        self.length, self.owners, self.seen = length, owners, set()

    def fresh(self, b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for *key, row in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
            key = tuple(key)
            keep.append(key not in self.seen and self.owners.get(key, row) == row)
            if keep[-1]:
                self.seen.add(key)
        if len(self.seen) > RECENT:
            self.seen.clear()
        return b.filter(pa.array(keep, pa.bool_()))

    def of(self, b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(bytes, row, start in the text, first window, last window, core) of a piece's regions."""
        data, off = V.bytes_of(b.column(2))
        for i, j in V.chunks(off):
            if off[j] - off[i] <= PIECE:
                pieces = [(0, data[off[i] : off[j]], off[i : j + 1] - off[i])]
            else:
                pieces = [(at - int(off[i]), data[at : min(at + PIECE + self.length - 1, off[j])], None) for at in range(int(off[i]), int(off[j]), PIECE)]
            for begin, part, own in pieces:
                own = np.array([0, len(part)]) if own is None else own
                lo, hi, key = regions(part, own, self.length)
                row = np.searchsorted(own, lo, side="right") - 1
                yield part, row + i, lo - own[row] + begin, lo, hi, key.view(np.int64)


class Repeats:
    """The repeated strings of a corpus (t1, t2, text, row); see the module's text. `owners` is a
    broadcast map from frequent texts to the row that stands for them."""

    def __init__(self, texts: DataFrame, length: int, scratch: Scratch, owners):
        self.texts, self.length, self.scratch, self.owners, self.spark = texts, length, scratch, owners, texts.sparkSession

    def core_marks(self, size: int):
        length, owners = self.length, self.owners

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Pieces(length, owners.value)
            for b in batches:
                for *_, key in own.of(own.fresh(b)):
                    yield pa.RecordBatch.from_arrays([pa.array(key)], ["k"])

        # an anchor owns half of a window on average, and two cores
        keys = 4 * size // (length - GRAM + 2)
        return self.spark.sparkContext.broadcast(bitmap(self.texts.mapInArrow(V.lean(run), "k long"), bits_for(keys), twice=True))

    def found(self, marks) -> DataFrame:
        """A row for each region whose core is marked: text, start, windows, core, digest."""
        length, owners = self.length, self.owners
        names = ["t1", "t2", "start", "n", "k", "c1", "c2"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Pieces(length, owners.value)
            for b in batches:
                b = own.fresh(b)
                for part, row, start, lo, hi, key in own.of(b):
                    ok = marked(key, marks.value)
                    c, row = digests(memoryview(part), lo[ok], hi[ok] + length), pa.array(row[ok])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(start[ok]), pa.array(hi[ok] - lo[ok] + 1, pa.int32()), pa.array(key[ok]), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())], names)

        return self.texts.mapInArrow(V.lean(run), "t1 long, t2 long, start long, n int, k long, c1 long, c2 long")

    def contents(self, marks, parts) -> DataFrame:
        """Of each wanted region, known by the hash t1 ^ start of one place, core, part and bytes.

        Other places pass the marks now and then, which adds up for a region with very many; so
        a task sends a region once."""
        length, owners = self.length, self.owners

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sent = Pieces(length, owners.value), set()
            hot, many = parts.value
            for b in batches:
                b = own.fresh(b)
                t1 = b.column(0).to_numpy()
                for part, row, start, lo, hi, key in own.of(b):
                    ok = np.flatnonzero(marked(t1[row] ^ start, marks.value))
                    lo, end, key, raw = lo[ok], hi[ok] + length, key[ok], part.tobytes()
                    c = digests(memoryview(raw), lo, end)
                    new = []
                    for i, region in enumerate(zip(key.tolist(), *c.T.tolist())):
                        if region not in sent:
                            sent.add(region)
                            new.append(i)
                    if len(sent) > SENT:
                        sent.clear()
                    lo, end, key, c = lo[new], end[new], key[new], c[new]
                    split = np.ones(len(key), np.int64)
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                        split = np.where(hot[at] == key, many[at], 1)
                    own_part = (np.ascontiguousarray(c[:, 1]).view(U) % split.astype(U)).astype(np.int32)
                    content = pa.array([raw[x:y] for x, y in zip(lo.tolist(), end.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own_part), pa.array(split, pa.int32()), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), content], ["k", "part", "parts", "c1", "c2", "content"])

        return self.texts.mapInArrow(V.lean(run), "k long, part int, parts int, c1 long, c2 long, content binary")

    def solve(self, contents: DataFrame) -> DataFrame:
        """(c1, c2, first, last) of runs of repeated windows in a shard, and, of cores with
        several shards, (k, range, part, run), a sorted run of its distinct windows."""
        length = self.length
        names = ["c1", "c2", "first", "last", "k", "range", "run"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 7, types)], names)

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            parts = rows[0][2]
            if len(rows) == 1 and parts == 1:
                return
            held = [r[5] for r in rows]
            known, order = repeated_windows(held, length)
            yield batch([(r[3], r[4], x, y, None, None, None) for r, k in zip(rows, known) if k.any() for x, y in runs_of(k).tolist()])
            if parts == 1:
                return
            # one window of those that are equal stands for them; its region is where it is sought
            data = b"".join(held)
            sizes = np.array([len(x) for x in held])
            begins = np.cumsum(sizes) - sizes
            two = digests(memoryview(data), order, order + length).view(U)
            at = np.lexsort((two[:, 1], two[:, 0]))
            two, order = two[at], order[at]
            own = np.searchsorted(begins, order, side="right") - 1
            e = np.zeros(len(two), DIGEST)
            e["d"], e["e"], e["at"] = two[:, 0], two[:, 1], order - begins[own]
            e["c1"], e["c2"] = np.array([r[3] for r in rows])[own], np.array([r[4] for r in rows])[own]
            new = np.ones(len(e), bool)
            new[1:] = (two[1:] != two[:-1]).any(1)
            e = e[new]
            group = (e["d"] >> U(32)) * U(4 * parts) >> U(32)
            cuts = np.searchsorted(group, np.arange(4 * parts + 1).astype(U))
            yield batch([(None, None, None, None, rows[0][0], i, e[x:y].tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of shards: whole cores (or one part of a core), up to SHARD bytes."""
            group: list[tuple] = []
            size = 0
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if group and row[:2] == group[-1][:2]:
                        if row[3:5] == group[-1][3:5]:  # the same region from another task
                            continue
                    elif group and (size > SHARD or row[2] > 1 or group[-1][2] > 1):
                        yield from out(group)
                        group, size = [], 0
                    group.append(row)
                    size += len(row[5])
            if group:
                yield from out(group)

        dealt = contents.repartition("k", "part").sortWithinPartitions("k", "part", "c1", "c2")
        return dealt.mapInArrow(V.lean(run), "c1 long, c2 long, first int, last int, k long, range int, run binary")

    def merge(self, solved: DataFrame) -> DataFrame:
        """(c1, c2, first, last) of windows that several shards of a core hold.

        A window's one place that is known stands in one region; the others of its shard are
        found there already, if there are any.
        """

        def out(runs: list[np.ndarray]) -> pa.RecordBatch:
            own = np.concatenate([r[hit] for r, hit in zip(runs, across(runs))])
            at = pa.array(own["at"].copy())
            return pa.RecordBatch.from_arrays([pa.array(own["c1"].copy()), pa.array(own["c2"].copy()), at, at], ["c1", "c2", "first", "last"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, runs = None, []
            for b in batches:
                for *own, x in zip(*(b.column(c).to_pylist() for c in range(2)), b.column(2)):
                    if key not in (None, own):
                        yield out(runs)
                        runs = []
                    key = own
                    runs.append(np.frombuffer(x.as_buffer(), DIGEST))
            if runs:
                yield out(runs)

        runs = solved.where("run is not null").select("k", "range", "run")
        return runs.repartition("k", "range").sortWithinPartitions("k", "range").mapInArrow(V.lean(run), "c1 long, c2 long, first int, last int")

    def spans(self, size: int, single: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(t1, t2, spans) of texts that occur once: the first and last starts of repeated
        strings. `single` drops the rows of all other texts from a table."""
        spark, scratch = self.spark, self.scratch
        marks = self.core_marks(size)
        found = scratch.put(self.found(marks), "regions")
        marks.unpersist()
        alike = found.groupBy("k", "c1", "c2").agg(F.count("*").alias("times"), F.min(F.col("t1").bitwiseXOR(F.col("start"))).alias("place"))
        alike = scratch.put(alike, "alike")
        kinds = scratch.put(alike.groupBy("k").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
        wanted = alike.join(kinds, "k").select("place")
        n = int(kinds.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0])
        # at most one core in REGIONS wanted regions
        hot = kinds.where(F.col("kinds") > REGIONS).select("k", F.ceil(F.col("kinds") / REGIONS).alias("parts")).orderBy("k").collect()
        parts = spark.sparkContext.broadcast((np.array([r.k for r in hot], np.int64), np.array([r.parts for r in hot], np.int64)))
        places = spark.sparkContext.broadcast(bitmap(wanted, bits_for(n)))
        solved = scratch.put(self.solve(self.contents(places, parts)), "solved")
        places.unpersist()
        inner = solved.where("run is null").select("c1", "c2", "first", "last")
        if hot:
            inner = inner.union(self.merge(solved))
        # regions that occur more than once are repeats as a whole; the most frequent ones, of
        # which there are HOT at most, are told to every task, so that no key is very frequent
        total = found.count()
        whole = alike.where("times > 1")
        often = whole.where(F.col("times") > total / HOT).select("c1", "c2", F.lit(True).alias("often"))
        rows = found.join(F.broadcast(often), ["c1", "c2"], "left") if total else found.withColumn("often", F.lit(None).cast("boolean"))
        rest = inner.union(whole.where(F.col("times") <= total / HOT).select("c1", "c2", F.lit(0).alias("first"), F.lit(None).cast("int").alias("last")))
        every = F.col("start") + F.col("n") - 1
        sure = single(rows.where("often")).select("t1", "t2", F.col("start").alias("first"), every.alias("last"))
        others = rows.where("often is null").select("t1", "t2", "start", "n", "c1", "c2")
        others = single(others).join(rest, ["c1", "c2"])
        others = others.select("t1", "t2", (F.col("start") + F.col("first")).alias("first"), F.coalesce(F.col("start") + F.col("last"), every).alias("last"))
        out = sure.union(others).groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
        out = scratch.put(out, "spans")
        scratch.drop("regions", "alike", "kinds", "solved")
        return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), scratch: Scratch | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, n_bytes, n_removed, n_spans, kept_sha256,
    and `kept`, the remaining bytes, if asked for.

    Every byte of a string of `length` bytes that also starts at another place of any text goes;
    strings keep to one text and are judged on the input. Null texts are empty; texts shorter
    than `length` stay whole. Of rows with equal texts all lose everything, repeated rows too.
    Very long texts are worked on in overlapping pieces; texts and strings are told apart by
    128-bit hashes. Columns of any other name are ignored unless kept; kept ones may not be
    named like those of the result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    if length < GRAM:
        raise ValueError(f"strings of fewer than {GRAM} bytes aren't searched")
    own = [f"_{i}" for i in range(len(keep))]
    text = whole_text(docs)
    rows = docs.select(*(docs[c].alias(x) for c, x in zip(keep, own)), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    # rows alike in all that is kept share a mark: both are read then
    texts = rows.where(F.octet_length("text") >= length).select("t1", "t2", "text", F.xxhash64(F.lit(0), *(F.col(x).cast("string") for x in own)).alias("row"))
    counts = texts.groupBy("t1", "t2").agg(F.count("*").alias("times"), F.min("row").alias("owner")).where("times > 1")
    copies = scratch.put(counts, "copies")
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    hot = spark.sparkContext.broadcast({(r.t1, r.t2): r.owner for r in copies.where(F.col("times") > max(n / HOT, COPIES)).select("t1", "t2", "owner").collect()})
    twice = copies.select("t1", "t2")
    spans = Repeats(texts, length, scratch, hot).spans(size, lambda df: df.join(twice, ["t1", "t2"], "left_anti"))
    n_spans, n_twice = spans.count(), copies.count()
    some = spark.sparkContext.broadcast(bitmap(spans.select("t1"), bits_for(n_spans)))
    again = spark.sparkContext.broadcast(bitmap(copies.select("t1"), bits_for(n_twice)))
    release(spark)
    empty = hashlib.sha256(b"").hexdigest()
    m = len(keep)
    state = T.StructType([*(T.StructField(x, docs.schema[c].dataType) for c, x in zip(keep, own)), *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, t1 long, t2 long, open boolean")])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of texts that surely have no repeats or are frequent; others wait for the join."""
        serial = 0
        for b in batches:
            t1, t2 = b.column(m + 1).to_numpy(), b.column(m + 2).to_numpy()
            partial, whole = marked(t1, some.value), marked(t1, again.value)
            cells = []
            for i, x in enumerate(b.column(m)):
                raw = x.as_buffer()
                big = raw is not None and raw.size >= length
                if big and (int(t1[i]), int(t2[i])) in hot.value:
                    cells.append((raw.size, raw.size, 1, empty, b"" if with_text else None, None))
                    continue
                wait = big and (partial[i] or whole[i])
                carried = raw.to_pybytes() if with_text or big and partial[i] else None
                cells.append((raw.size, 0, 0, hashlib.sha256(raw).hexdigest(), carried, wait))
            columns = list(zip(*cells)) or [()] * 6
            wait = np.array([bool(x) for x in columns[5]], bool)
            spread = V.mix(np.arange(serial, serial + len(cells)).astype(U)).view(np.int64)
            serial += len(cells)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:m], *(pa.array(x, t) for x, t in zip(columns, types)), pa.array(np.where(wait, t1, spread)), pa.array(np.where(wait, t2, 0)), pa.array(wait)], state.names)

    waiting = rows.mapInArrow(V.lean(known), state)
    answers = spans.select("t1", "t2", "spans", F.lit(True).alias("open")).unionByName(twice.withColumns({"spans": F.lit(None).cast(spans.schema["spans"].dataType), "open": F.lit(True)}))
    answers = answers.withColumn("hit", F.lit(True))
    joined = waiting.join(answers, ["t1", "t2", "open"], "left").select(*state.names[: m + 5], "hit", "spans")
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(m + i).to_pylist() for i in range(5)]
            hit = b.column(m + 5).is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(hit).tolist():
                own = b.column(m + 6)[i]
                if not own.is_valid:  # a text that occurs twice
                    columns[1][i], columns[2][i], columns[3][i], columns[4][i] = columns[0][i], 1, empty, b""
                    continue
                raw = np.frombuffer(columns[4][i], np.uint8)
                step = np.zeros(len(raw) + 1, np.int64)
                np.add.at(step, own.values.field(0).to_numpy(), 1)
                np.add.at(step, own.values.field(1).to_numpy() + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = raw[~gone].tobytes()
                columns[1][i], columns[2][i] = int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=0) == 1).sum())
                columns[3][i], columns[4][i] = hashlib.sha256(kept).hexdigest(), kept
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            out = [pa.array(x, t) for x, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*b.columns[:m], *out[: 4 + with_text]], schema.names)

    return joined.mapInArrow(V.lean(apply), schema)
