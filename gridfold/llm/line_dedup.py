"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z as a-z, ASCII white space between). It goes if an earlier
line, by (doc_id, line number), has a Jaccard similarity of `num / den` or more with it.

Words are ordered by rarity: by counts of all words in a table of fixed size, which is
broadcast. Equal sets meet by an aggregation on a 128-bit key of the set. Different sets meet
by an equi-join on the words of their prefixes, under the length, prefix, positional and
parity-bitmap filters; survivors are verified on their full sets. Everything is keyed by a word
or a set, so no group of equal lines is ever expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.llm import textvec as V
from gridfold.llm.common import Scratch, spread_join, unused, whole_text
from gridfold.llm.textvec import U

#: Jaccard threshold 4/5.
NUM, DEN = 4, 5
#: Buckets of the word counts (8 bytes each, broadcast), and bits of the marks of keys.
BUCKET_BITS = 21
BUCKETS = 1 << BUCKET_BITS
MARKS = 1 << 24
_BLOCK = 1 << 14


def merged_blocks(parts: DataFrame, length: int, how: str) -> np.ndarray:
    """Arrays of fixed size, one a task in blocks (block, data), merged by block: `sum`, `or`, or `twice`."""
    dtype = np.int64 if how == "sum" else np.uint8

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_buffer(), dtype)
                if i not in got:
                    got[i] = x.copy()
                elif how == "sum":
                    got[i] += x
                elif how == "or":
                    got[i] |= x
                else:  # what was seen, and what was seen twice
                    half = len(x) // 2
                    got[i][half:] |= x[half:] | (got[i][:half] & x[:half])
                    got[i][:half] |= x[:half]
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([x.tobytes() for x in got.values()], pa.binary())], ["block", "data"])

    out = np.zeros(length, dtype)
    rows = parts.repartition("block").mapInArrow(V.lean(merge), "block int, data binary").collect()
    size = len(rows[0][1]) // np.dtype(dtype).itemsize if rows else 0
    for i, x in rows:
        out[i * size : (i + 1) * size] = np.frombuffer(x, dtype)
    return out


def blocks_of(x: np.ndarray, size: int) -> pa.RecordBatch:
    """The blocks of a task's array that aren't empty."""
    own = [(i, x[i * size : (i + 1) * size]) for i in range(len(x) // size)]
    own = [(i, y.tobytes()) for i, y in own if y.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([y for _, y in own], pa.binary())], ["block", "data"])


def word_ranks(texts: DataFrame) -> np.ndarray:
    """For each bucket of word hashes its place by rarity (a permutation), from all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            data, off = V.bytes_of(b.column(0))
            found = [V.words(data[off[i] : off[j]], off[i:j] - off[i])[2] & U(BUCKETS - 1) for i, j in V.chunks(off)]
            np.add.at(n, np.concatenate(found or [np.zeros(0, U)]).astype(np.int64), 1)
        yield blocks_of(n, _BLOCK)

    n = merged_blocks(texts.mapInArrow(V.lean(count), "block int, data binary"), BUCKETS, "sum")
    ranks = np.empty(BUCKETS, np.uint32)
    ranks[np.argsort(n, kind="stable")] = np.arange(BUCKETS, dtype=np.uint32)
    return ranks


class Lines:
    """The lines of a chunk that have words: document, number, and sorted sets of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray):
        n = len(data)
        begins = np.zeros(n + 1, np.int32)
        begins[np.flatnonzero(data == 10) + 1] = 1
        begins[offsets[:-1]] = 1
        line_at = np.cumsum(begins) - 1
        starts, _, h = V.words(data, offsets[:-1])
        line = line_at[starts]
        bits = U(43)
        rest = 43 - BUCKET_BITS
        value = ranks[(h & U(BUCKETS - 1)).astype(np.int64)].astype(U) << U(rest) | (h >> U(BUCKET_BITS)) & U((1 << rest) - 1)
        # one sort puts the words of each line in the global order, rarest first
        if begins.sum() <= 1 << 21:
            order = np.argsort(line.astype(U) << bits | value)
        else:  # line numbers don't fit beside the value
            order = np.lexsort((value, line))
        line, h, value = line[order], h[order], value[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        self.line, self.hash, self.value = line[keep], h[keep], value[keep]
        self.first = np.flatnonzero(np.diff(self.line, prepend=-1))
        self.size = np.diff(np.append(self.first, len(self.line)))
        of = self.line[self.first]
        text_first_line = line_at[np.minimum(offsets[:-1], max(n - 1, 0))] if n else np.zeros(len(offsets) - 1, np.int32)
        # a text of no bytes shares its place with the next one, which owns the line
        has = np.diff(offsets) > 0
        owners = np.flatnonzero(has)
        self.text = owners[np.searchsorted(text_first_line[has], of, side="right") - 1] if len(of) else of
        self.number = of - text_first_line[self.text] if len(of) else of
        if len(self.first):
            with np.errstate(over="ignore"):
                self.k1 = np.add.reduceat(V.mix(self.hash, 0x51ED270B), self.first)
                self.k2 = np.add.reduceat(V.mix(self.hash, 0x3C6EF372), self.first)
            one, upper = U(1) << (self.hash >> U(58)), self.hash & U(1) == 1
            self.b1 = np.bitwise_xor.reduceat(np.where(upper, U(0), one), self.first)
            self.b2 = np.bitwise_xor.reduceat(np.where(upper, one, U(0)), self.first)
        else:
            self.k1 = self.k2 = self.b1 = self.b2 = np.zeros(0, U)

    def prefixes(self, num: int, den: int) -> pa.ListArray:
        """Of each line the words of which another set must share one, as 32-bit values."""
        n = self.size
        p = np.where(n * (den - num) >= num, n - (num * n + den - 1) // den + 1, 0)
        at = np.concatenate([[0], np.cumsum(p)]).astype(np.int32)
        rows = np.repeat(self.first - at[:-1], p) + np.arange(at[-1])
        v = (V.mix(self.value[rows]) >> U(32)).astype(np.uint32).view(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(v, pa.int32()))


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def line_table(docs: DataFrame, ranks, num: int, den: int) -> DataFrame:
    """A row for each line with words: doc_id, line, key of its set, size, parity bitmap (128 bits), prefix."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("line int, k1 long, k2 long, n int, b1 long, b2 long, prefix array<int>")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = V.bytes_of(b.column(1))
            for i, j in V.chunks(off):
                x = Lines(data[off[i] : off[j]], off[i : j + 1] - off[i], ranks.value)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(x.text + i)), pa.array(x.number, pa.int32()), _int64(x.k1), _int64(x.k2), pa.array(x.size, pa.int32()), _int64(x.b1), _int64(x.b2), x.prefixes(num, den)], names)

    return docs.select("doc_id", whole_text(docs).alias("_text")).mapInArrow(V.lean(run), schema)


def marks_of(keys: DataFrame, twice: bool = False, marks: int = MARKS) -> np.ndarray:
    """A bitmap of fixed size over hashes of a column of longs: seen, or seen at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(marks // 8, np.uint8), np.zeros(marks // 8, np.uint8)
        for b in batches:
            at, times = np.unique(mark(b.column(0).to_numpy(zero_copy_only=False), marks), return_counts=True)
            if not len(at):
                continue
            bits = np.uint8(128) >> (at & 7).astype(np.uint8)
            first = np.flatnonzero(np.diff(at >> 3, prepend=-1))
            byte, one = at[first] >> 3, np.bitwise_or.reduceat(bits, first)
            again[byte] |= seen[byte] & one | np.bitwise_or.reduceat(np.where(times > 1, bits, np.uint8(0)), first)
            seen[byte] |= one
        seen, again = seen.reshape(-1, _BLOCK), again.reshape(-1, _BLOCK)
        yield blocks_of((np.concatenate([seen, again], axis=1) if twice else seen).ravel(), _BLOCK * (1 + twice))

    x = merged_blocks(keys.mapInArrow(V.lean(run), "block int, data binary"), marks // 8 * (1 + twice), "twice" if twice else "or")
    return x.reshape(-1, 2, _BLOCK)[:, 1].ravel() if twice else x


def mark(keys: np.ndarray, marks: int) -> np.ndarray:
    return (V.mix(keys.astype(np.int64).view(U)) & U(marks - 1)).astype(np.int64)


def marked(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = mark(keys, 8 * len(bitmap))
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


#: Sizes and places are stored up to so much; the filters pass whatever is as large.
LARGE = (1 << 16) - 1
#: One word of the prefix of one set.
#: `order` rises with the place of the set's first line, though places near each other may share one.
ENTRY = np.dtype([("w", np.uint32), ("n", np.uint16), ("pos", np.uint16), ("order", np.uint32), ("k1", np.int64), ("b1", U), ("b2", U)])


def entries(b: pa.RecordBatch) -> np.ndarray:
    """The entries of a batch of (k1, n, b1, b2, order, prefix)."""
    lists = b.column(5)
    w = lists.flatten().to_numpy(zero_copy_only=False)
    p = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(p)), p)
    e = np.empty(len(w), ENTRY)
    e["w"], e["pos"] = w.view(np.uint32), np.minimum(np.arange(len(w)) - np.repeat(np.cumsum(p) - p, p), LARGE)
    for name, i in (("k1", 0), ("n", 1), ("b1", 2), ("b2", 3), ("order", 4)):
        x = b.column(i).to_numpy(zero_copy_only=False)
        e[name] = x.view(U)[row] if name[0] == "b" else np.minimum(x, LARGE)[row] if name == "n" else x[row]
    return e


def bins_of(load: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of neighbouring fine buckets with at most `most` entries together; and into how
    many parts each bin is split, over 1 where one bucket holds more."""
    bins, splits, held = np.zeros(len(load), np.int32), [1], 0
    for i, n in enumerate(load.tolist()):
        if held and held + n > most:
            splits.append(1)
            held = 0
        held += n
        bins[i] = len(splits) - 1
        splits[-1] = max(splits[-1], -(-n // most))
    return bins, np.array(splits, np.int32)


def joined(e: np.ndarray, apart: np.ndarray | None, num: int, den: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, key of an earlier set, 2 x differing bits, and 1 if the order can't tell) of entries of one word that pass the length,
    prefix, positional and bitmap filters; both ways round where the order can't tell.
    `apart`: which of two parts an entry is of, if only pairs across count."""
    order = np.lexsort((e["k1"], e["n"], e["w"]))
    e = e[order]
    apart = None if apart is None else apart[order]
    n, pos = e["n"].astype(np.int64), e["pos"].astype(np.int64)
    key = e["w"].astype(np.int64) << 31 | n
    last = np.searchsorted(key, e["w"].astype(np.int64) << 31 | np.minimum(n * den // num, (1 << 31) - 1), side="right")
    at = np.arange(len(e))
    own = n - (-(-2 * num * n // (num + den))) + 1  # the prefix of a set with one as long or longer
    many = np.where((pos < own) | (n == LARGE), last - at - 1, 0)
    upto = np.cumsum(many)
    i = 0
    while i < len(e):
        done = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + block, side="right")))
        m = many[i:j]
        x = np.repeat(at[i:j], m)
        y = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m) + x + 1
        i = j
        need = -(-num * (n[x] + n[y]) // (num + den))
        ok = np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
        ok |= n[y] == LARGE
        x, y, need = x[ok], y[ok], need[ok]
        differ = np.bitwise_count(e["b1"][x] ^ e["b1"][y]).astype(np.int64) + np.bitwise_count(e["b2"][x] ^ e["b2"][y])
        ok = (differ <= n[x] + n[y] - 2 * need) | (n[y] == LARGE)
        ok &= e["k1"][x] != e["k1"][y]
        if apart is not None:
            ok &= apart[x] != apart[y]
        x, y, differ = x[ok], y[ok], differ[ok]
        for late, early in ((x, y), (y, x)):
            ok = e["order"][late] >= e["order"][early]
            if ok.any():
                tied = e["order"][late[ok]] == e["order"][early[ok]]
                yield e["k1"][late[ok]], e["k1"][early[ok]], 2 * differ[ok] + tied


def likeliest(late: np.ndarray, early: np.ndarray, differ: np.ndarray) -> list[pa.Array]:
    """Of each late set the candidate with the fewest differing bits, and how many it has."""
    order = np.lexsort((early, differ, late))
    late, early, differ = late[order], early[order], differ[order]
    first = np.flatnonzero(np.diff(late, prepend=~late[:1]))
    return [pa.array(late[first]), pa.array(early[first]), pa.array(differ[first]), pa.array(np.diff(np.append(first, len(late))))]


def candidates(sets: DataFrame, num: int, den: int, only: np.ndarray | None = None, words: np.ndarray | None = None, most: int = 200_000, fine: int = 1 << 16) -> DataFrame:
    """(a, b, differ, n): keys of sets, and of earlier ones that may be similar.

    Of each set only the likeliest candidate of a bin, and their number there, unless `only`
    is given: then all candidates of the sets that it marks, by the words that `words` marks,
    those of their prefixes. A pair may come more than once.

    Entries meet by their word in bins of about equal load, sent as packed blocks; a word with
    more than `most` entries is split into parts, and each two parts meet in a task of their own.
    """
    spark = sets.sparkSession
    low, high = sets.agg(F.min("place.doc_id.id"), F.max("place.doc_id.id")).first()
    span = float((high or 0) - (low or 0)) + 1
    order = F.coalesce(F.floor((F.col("place.doc_id.id") - F.lit(low or 0)) / F.lit(span) * F.lit(4294967295.0)), F.lit(0)).cast("long")
    sets = sets.where(F.size("prefix") > 0).select("k1", "n", "b1", "b2", order.alias("order"), "prefix")
    if only is not None:
        only, words = spark.sparkContext.broadcast(only), spark.sparkContext.broadcast(words)

    def own(b: pa.RecordBatch) -> np.ndarray:
        e = entries(b)
        return e if words is None else e[marked(np.ascontiguousarray(e["w"]).view(np.int32), words.value)]

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(fine, np.int64)
        for b in batches:
            n += np.bincount(own(b)["w"] % fine, minlength=fine)
        yield blocks_of(n, _BLOCK)

    plan = spark.sparkContext.broadcast(bins_of(merged_blocks(sets.mapInArrow(V.lean(loads), "block int, data binary"), fine, "sum"), most))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, splits = plan.value
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(held)
            at = bins[e["w"] % fine]
            order = np.argsort(at, kind="stable")
            e, at = e[order], at[order]
            rows = []
            for lo, hi in zip(first := np.flatnonzero(np.diff(at, prepend=-1)), np.append(first[1:], len(at))):
                k, mine = int(at[lo]), e[lo:hi]
                if (s := int(splits[k])) == 1:
                    rows.append((k, 0, 0, 0, mine.tobytes()))
                    continue
                part = (V.mix(np.ascontiguousarray(mine["k1"]).view(U)) % U(s)).astype(np.int64)
                for i in range(s):
                    if len(some := mine[part == i]):
                        rows += [(k, min(i, j), max(i, j), i, some.tobytes()) for j in range(s)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (*(pa.int32(),) * 4, pa.binary()))], ["bin", "i", "j", "part", "data"])

        for b in batches:
            held.append(own(b))
            size += len(held[-1])
            if size > 300_000:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    names = ["a", "b", "differ", "n"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, marks = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(parts)
            apart = np.concatenate(marks) if key[1] != key[2] else None
            for late, early, differ in joined(e, apart, num, den):
                if only is not None:
                    ok = marked(late, only.value)
                    pairs = np.unique(np.stack([late[ok], early[ok]], axis=1), axis=0)
                    zero = pa.array(np.zeros(len(pairs), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), zero, zero], names)
                else:
                    yield pa.RecordBatch.from_arrays(likeliest(late, early, differ), names)

        for b in batches:
            for k, i, j, part, data in zip(*(b.column(c).to_pylist() for c in range(4)), b.column(4)):
                if key != (k, i, j):
                    if key:
                        yield from out()
                    key, parts, marks = (k, i, j), [], []
                parts.append(np.frombuffer(data.as_buffer(), ENTRY))
                marks.append(np.full(len(parts[-1]), part == i))
        if key:
            yield from out()

    dealt = sets.mapInArrow(V.lean(deal), "bin int, i int, j int, part int, data binary")
    n = max(1, int(plan.value[1].astype(np.int64) @ (plan.value[1] + 1) // 2))
    return dealt.repartition(min(n, 20_000), "bin", "i", "j").sortWithinPartitions("bin", "i", "j").mapInArrow(V.lean(meet), "a long, b long, differ long, n long")


def similar_sets(docs: DataFrame, sets: DataFrame, ranks, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(k1, k2, o1, o2): sets with a similar one, an earlier one if there is any.

    First each set's likeliest candidate is verified. A set that it doesn't settle, and that has
    other candidates, then has all of them verified; groups of near copies settle at once.
    """
    best = candidates(sets, num, den).groupBy("a").agg(F.min(F.struct("differ", "b")).alias("m"), F.sum("n").alias("n"))
    best = scratch.put(best.select("a", F.col("m.b").alias("b"), F.col("m.differ").alias("differ"), "n"), "best")
    links = verified(docs, sets, best.select("a", "b"), ranks, num, den, scratch, "first")
    settled = best.where("differ % 2 = 0").join(links.select(F.col("k1").alias("a")), "a", "left_semi").select("a")
    left = scratch.put(best.where("n > 1").join(settled, "a", "left_anti").select(F.col("a").alias("k1")), "left")
    if not left.head(1):
        return links
    words = sets.join(left, "k1", "left_semi").select(F.explode("prefix").alias("w"))
    rest = candidates(sets, num, den, marks_of(left), marks_of(words)).select("a", "b").join(left.select(F.col("k1").alias("a")), "a", "left_semi").distinct()
    rest = scratch.put(rest.join(best.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    return links.union(verified(docs, sets, rest, ranks, num, den, scratch, "second"))


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, ranks, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """(k1, k2, o1, o2) of those pairs (a, b) whose full sets are similar enough. The sets come
    from a pass over the documents that skips those whose ids aren't marked."""
    spark = docs.sparkSession
    keys = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct().join(sets.select("k1", F.xxhash64("place.doc_id").alias("doc")), "k1")
    keys = scratch.put(keys, f"keys-{name}")
    wanted, owners = (spark.sparkContext.broadcast(marks_of(keys.select(c))) for c in ("k1", "doc"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(marked(b.column(0).to_numpy(), owners.value), pa.bool_()))
            data, off = V.bytes_of(b.column(1))
            for i, j in V.chunks(off):
                x = Lines(data[off[i] : off[j]], off[i : j + 1] - off[i], ranks.value)
                k1 = x.k1.view(np.int64)
                at = np.flatnonzero(marked(k1, wanted.value))
                at = at[np.unique(k1[at], return_index=True)[1]]
                h = [np.sort(x.hash[x.first[r] : x.first[r] + x.size[r]]).tobytes() for r in at]
                yield pa.RecordBatch.from_arrays([_int64(x.k1[at]), _int64(x.k2[at]), pa.array(h, pa.binary())], ["k1", "k2", "words"])

    full = docs.select(F.xxhash64("doc_id"), whole_text(docs)).mapInArrow(V.lean(tokens), "k1 long, k2 long, words binary").join(keys.select("k1"), "k1", "left_semi").dropDuplicates(["k1", "k2"])
    full = scratch.put(full, f"words-{name}")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column(2), b.column(5)):
                p, q = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common * den >= num * (len(p) + len(q) - common))
            b = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in (0, 1, 3, 4)], ["k1", "k2", "o1", "o2"])

    one = full.select(F.col("k1").alias("a"), F.col("k2").alias("a2"), F.col("words").alias("x"))
    two = full.select(F.col("k1").alias("b"), F.col("k2").alias("b2"), F.col("words").alias("y"))
    found = pairs.join(one, "a").join(two, "b").select("a", "a2", "x", "b", "b2", "y").mapInArrow(V.lean(verify), "k1 long, k2 long, o1 long, o2 long")
    found = scratch.put(found, f"found-{name}")
    scratch.drop(f"words-{name}", f"keys-{name}")
    return found


def repeated_lines(docs: DataFrame, num: int = NUM, den: int = DEN, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, lines): the numbers, from 0, of lines that an earlier line repeats or resembles."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    # null ids come before all others
    docs = docs.select(F.struct(F.col("doc_id").isNotNull().alias("given"), F.col("doc_id").alias("id")).alias("doc_id"), whole_text(docs).alias("text"))
    ranks = spark.sparkContext.broadcast(word_ranks(docs.select("text")))
    lines = scratch.put(line_table(docs, ranks, num, den), "lines")
    place = F.struct("doc_id", "line")
    sets = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line", "n", "b1", "b2", "prefix")).alias("s"), F.count("*").alias("times"))
    sets = scratch.put(sets.select("k1", "k2", "times", F.struct("s.doc_id", "s.line").alias("place"), "s.n", "s.b1", "s.b2", "s.prefix"), "sets")
    links = scratch.put(similar_sets(docs, sets, ranks, num, den, scratch), "links")
    sets = scratch.put(sets.select("k1", "k2", "times", "place"), "places")
    scratch.drop("sets", "best", "rest", "left")
    known = sets.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), "place")
    near = links.join(known, ["o1", "o2"]).groupBy("k1", "k2").agg(F.min("place").alias("near"))
    first = (
        sets.select("k1", "k2", "times", "place")
        .join(near, ["k1", "k2"], "left")
        .where((F.col("times") > 1) | (F.col("near") < F.col("place")))
        .select("k1", "k2", F.least("place", F.coalesce("near", "place")).alias("earliest"))
    )
    total = sets.agg(F.sum("times")).first()[0] or 0
    often = sets.select("k1", "k2", F.col("times").alias("_n"))
    gone = spread_join(lines.select("k1", "k2", "doc_id", "line"), first, ["k1", "k2"], often, total).where(place > F.col("earliest"))
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines")).select(F.col("doc_id.id").alias("doc_id"), "lines")


def dedup_lines(docs: DataFrame, num: int = NUM, den: int = DEN, scratch: Scratch | None = None) -> DataFrame:
    """`docs` with text without its repeated lines, and n_lines and n_removed added.

    Lines end at a line feed. Lines without words always stay. Null and empty texts have one
    empty line and come back as they are. Lines are ordered by (doc_id, line number), null ids
    first; rows of one doc_id tie, so a line goes from all of them or from none at its place,
    and repeated rows don't remove each other. Columns named n_lines and n_removed are replaced,
    others of any name stay. Lines of any length are compared as whole sets.
    """
    docs = docs.drop("n_lines", "n_removed")
    of, which = unused(docs, "_id", "_gone")
    gone = repeated_lines(docs, num, den, scratch).select(F.col("doc_id").alias(of), F.col("lines").alias(which))
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([*docs.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, removed = [], [], []
            for text, lines in zip(b.column(at), b.column(len(names))):
                text = text.as_py()
                own = (text or "").split("\n")
                n.append(len(own))
                if lines.is_valid:
                    drop = set(lines.as_py())
                    drop = {i for i in drop if i < len(own) and own[i].strip(" \t\r\x0b\x0c")}
                    text = "\n".join(x for i, x in enumerate(own) if i not in drop)
                    removed.append(len(drop))
                else:
                    removed.append(0)
                texts.append(text)
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    same: Column = docs["doc_id"].eqNullSafe(gone[of])
    return docs.join(gone, same, "left").select(*(docs[c] for c in names), gone[which]).mapInArrow(cut, schema)
