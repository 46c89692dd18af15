"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of word shingles. Equal sets are one node from the start. Nodes that agree
in a band of their MinHash signature are candidates; a candidate's signatures are compared
batch by batch, and it is given up as soon as the posterior chance (uniform prior) that its
similarity reaches the threshold falls below `miss`. Survivors are confirmed on their full
sets of 64-bit shingle hashes, and confirmed links make components.

Groups are never expanded into all pairs. In a bucket every node meets one leader first;
components come from those links; only nodes of one bucket that are then still in different
components meet each other, in blocks, and only links that join components leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm import textvec as V
from gridfold.llm.common import GROUP, MANY, Scratch, spread_join, whole_text
from gridfold.llm.line_dedup import _int64, marked, marks_of
from gridfold.llm.textvec import U

BANDS, ROWS = 24, 5
BATCH = 20
#: Chance with which a pair at the threshold may be given up by its signature.
MISS = 1e-6
#: Nodes of a bucket that meet in one task.
PART = 2000


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = V.mix(np.arange(1, 2 * n + 1).astype(U), 0x1234567)
    return x[:n] | U(1), x[n:]


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over a set that isn't empty, upper 32 bits."""
    low = np.full(len(a), np.iinfo(U).max, U)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 1024):
            low = np.minimum(low, (s[i : i + 1024, None] * a + b).min(0))
    return (low >> U(32)).astype(np.uint32)


def least_matches(threshold: float, miss: float, upto: int, batch: int) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is given up).

    With a uniform prior the posterior of the similarity after m matches of n is a beta
    distribution, and the chance that it is `threshold` or more is that of at most m successes
    in n + 1 trials.
    """
    out = []
    for n in range(batch, upto + 1, batch):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def key_of(s: np.ndarray, bits: int) -> tuple[int, int]:
    """The key of a set; its first half of so many bits."""
    with np.errstate(over="ignore"):
        one, two = V.mix(s, 0x51ED270B).sum(dtype=U), V.mix(s, 0x3C6EF372).sum(dtype=U)
    return int((one >> U(64 - bits)).view(np.int64)), int(two.view(np.int64))


def nodes_of(docs: DataFrame, k: int, key_bits: int = 64) -> DataFrame:
    """A row for each document: doc_id, n_shingles, key of the set (k1, k2), band keys, and 16
    bits of each value of the signature."""
    a, b = permutations(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            data, off = V.bytes_of(x.column(1))
            n, keys, bands, bits = [], [], [], []
            for i, j in V.chunks(off):
                for s in V.shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], k):
                    n.append(len(s))
                    keys.append(key_of(s, key_bits))
                    if not len(s):
                        bands.append(None)
                        bits.append(None)
                        continue
                    sig = signature(s, a, b)
                    band = np.arange(BANDS).astype(U)
                    with np.errstate(over="ignore"):
                        for c in sig.reshape(BANDS, ROWS).T:
                            band = V.mix(band * U(0x9E3779B97F4A7C15) + c.astype(U))
                    bands.append(band.tobytes())
                    bits.append((sig & 0xFFFF).astype(np.uint16).tobytes())
            k12 = np.array(keys, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(n, pa.int64()), _int64(k12[:, 0]), _int64(k12[:, 1]), pa.array(bands, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "bands", "bits"])

    return docs.select("doc_id", whole_text(docs).alias("_text")).mapInArrow(V.lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, k1 long, k2 long, bands binary, bits binary")


def buckets_of(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of each band; only buckets whose mark at least two nodes share."""
    spark = nodes.sparkSession

    def explode(batches: Iterator[pa.RecordBatch], only=None) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys = np.frombuffer(b"".join(x.column(1).to_pylist()), np.int64)
            node = np.repeat(x.column(0).to_numpy(), BANDS)
            if only is not None:
                ok = marked(keys, only.value)
                keys, node = keys[ok], node[ok]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node)], ["bucket", "node"])

    shared = spark.sparkContext.broadcast(marks_of(nodes.select("node", "bands").mapInArrow(explode, "bucket long, node long").select("bucket"), twice=True, marks=1 << 26))
    return nodes.select("node", "bands").mapInArrow(lambda x: explode(x, shared), "bucket long, node long")


def connect(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node with an edge (u, v): root is the smallest node reachable.

    Large stars and small stars in turn; every step is a shuffle on one column of at most as
    many edges, written to the shared folder.
    """
    before, turn = None, 0
    edges = scratch.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    while True:
        turn += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.put(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Matcher:
    """Candidates of one corpus: Bayesian pruning, confirmation on full sets, components."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, percent: int, miss: float, scratch: Scratch, key_bits: int = 64, clash: dict[tuple[int, int], int] | None = None):
        self.docs, self.nodes, self.k, self.percent, self.miss, self.scratch = docs, nodes, k, percent, miss, scratch
        self.key_bits, self.clash = key_bits, clash or {}
        self.turn, self.links = 0, None

    def likely(self, pairs: DataFrame) -> DataFrame:
        """(a, b, matches) of those pairs that no batch of the signature rules out."""
        steps = least_matches(self.percent / 100, self.miss, BANDS * ROWS, BATCH)

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                p, q = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in (2, 3))
                at, m, done = np.arange(len(p)), np.zeros(len(p), np.int64), 0
                for n, least in steps:
                    m = m + (p[at, done:n] == q[at, done:n]).sum(1)
                    ok = m >= least
                    at, m, done = at[ok], m[ok], n
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([x.column(0).take(rows), x.column(1).take(rows), pa.array(m)], ["a", "b", "matches"])

        one = self.nodes.select(F.col("node").alias("a"), F.col("bits").alias("x"))
        two = self.nodes.select(F.col("node").alias("b"), F.col("bits").alias("y"))
        pairs = pairs.join(two, "b")
        return self.led(pairs, one).select("a", "b", "x", "y").mapInArrow(V.lean(prune), "a long, b long, matches long")

    def led(self, pairs: DataFrame, one: DataFrame) -> DataFrame:
        """`pairs` with what `one` knows of their leaders a, of which each may lead very many."""
        return spread_join(pairs, one, ["a"], self.leads, self.n_pairs)

    def full_sets(self, wanted: DataFrame) -> DataFrame:
        """(node, s): the sorted shingle hashes of the nodes `wanted`, from a pass over the
        documents that skips those whose ids aren't marked."""
        spark, k, key_bits, clash = self.docs.sparkSession, self.k, self.key_bits, self.clash
        rows = self.scratch.put(wanted.join(self.nodes.select("node", "doc_id"), "node"), f"wanted-{self.turn}")
        in_docs = spark.sparkContext.broadcast(marks_of(rows.select(F.xxhash64("doc_id"))))
        in_nodes = spark.sparkContext.broadcast(marks_of(rows.select("node")))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                x = x.filter(pa.array(marked(x.column(0).to_numpy(), in_docs.value), pa.bool_()))
                data, off = V.bytes_of(x.column(1))
                found: dict[int, bytes] = {}
                for i, j in V.chunks(off):
                    for s in V.shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], k):
                        key = key_of(s, key_bits)
                        key = clash.get(key, key[0])
                        if len(s) and marked(np.array([key]), in_nodes.value)[0]:
                            found[key] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "s"])

        full = self.docs.select(F.xxhash64("doc_id"), whole_text(self.docs)).mapInArrow(V.lean(sets), "node long, s binary").join(rows.select("node"), "node", "left_semi").dropDuplicates(["node"])
        full = self.scratch.put(full, f"sets-{self.turn}")
        self.scratch.drop(f"wanted-{self.turn}")
        return full

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """(u, v) of pairs (a, b) whose full sets are similar enough."""
        percent = self.percent
        full = self.full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                ok = []
                for p, q in zip(x.column(2), x.column(3)):
                    p, q = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(100 * common >= percent * (len(p) + len(q) - common))
                ok = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([x.column(0).filter(ok), x.column(1).filter(ok)], ["u", "v"])

        one = full.select(F.col("node").alias("a"), F.col("s").alias("x"))
        two = full.select(F.col("node").alias("b"), F.col("s").alias("y"))
        found = self.led(pairs.select("a", "b").join(two, "b"), one).select("a", "b", "x", "y").mapInArrow(V.lean(verify), "u long, v long")
        found = self.scratch.put(found, f"found-{self.turn}")
        self.scratch.drop(f"sets-{self.turn}")
        self.turn += 1
        return found

    def add(self, links: DataFrame) -> None:
        self.links = links if self.links is None else self.links.union(links)
        self.roots = self.scratch.put(connect(self.links, self.scratch, f"stars-{self.turn}"), f"roots-{self.turn}")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose nodes aren't in one component yet."""
        a, b = (self.roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")

    def match(self, pairs: DataFrame) -> None:
        """Confirm the likeliest pair of each node, then whatever may still join components."""
        pairs = self.scratch.put(pairs, f"pairs-{self.turn}")
        self.n_pairs = pairs.count()
        most = max(GROUP, self.n_pairs // MANY)
        self.leads = self.scratch.put(pairs.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") > most), f"leads-{self.turn}")
        likely = self.scratch.put(self.likely(pairs), f"likely-{self.turn}")
        best = likely.groupBy("b").agg(F.max(F.struct("matches", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
        self.add(self.confirmed(best))
        rest = self.scratch.put(self.apart(likely).join(best, ["a", "b"], "left_anti"), f"rest-{self.turn}")
        if rest.head(1):
            self.add(self.confirmed(rest))


    def across(self, held: DataFrame) -> DataFrame:
        """Links (u, v) that join components among (bucket, node, root), the nodes of buckets
        with several components.

        The nodes of a bucket meet in one task, or in parts of about PART nodes of which each
        two meet in one. There pairs are pruned by their signatures and confirmed on their full
        sets, likeliest first, unless links found before have joined them; a pair is looked at
        in the first bucket that it shares only.
        """
        steps, percent = least_matches(self.percent / 100, self.miss, BANDS * ROWS, BATCH), self.percent
        full = self.full_sets(held.select("node").distinct())
        parts = held.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        dealt = held.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "root")
        dealt = dealt.join(self.nodes.select("node", "bands", "bits"), "node").join(full, "node")
        dealt = dealt.select("bucket", "i", "j", "part", "node", "root", "bands", "bits", "s")

        def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
            bucket, i, j = rows[0][:3]
            part, node, root = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5))
            bands = np.frombuffer(b"".join(r[6] for r in rows), np.int64).reshape(len(rows), BANDS)
            bits = np.frombuffer(b"".join(r[7] for r in rows), np.uint16).reshape(len(rows), -1)
            found = []
            for x in range(len(rows) - 1):
                at = x + 1 + np.flatnonzero((root[x + 1 :] != root[x]) & ((part[x + 1 :] != part[x]) | (i == j)))
                m, done = np.zeros(len(at), np.int64), 0
                for n, least in steps:
                    m = m + (bits[at, done:n] == bits[x, done:n]).sum(1)
                    ok = m >= least
                    at, m, done = at[ok], m[ok], n
                same = bands[at] == bands[x]
                ok = bands[x][same.argmax(1)] == bucket
                found.append(np.stack([m[ok], np.full(ok.sum(), x), at[ok]], axis=1))
            above: dict[int, int] = {}

            def top(r: int) -> int:
                while r in above:
                    r = above[r]
                return r

            found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            for _, x, y in found[np.argsort(-found[:, 0], kind="stable")].tolist():
                p, q = top(int(root[x])), top(int(root[y]))
                if p != q:
                    u, v = np.frombuffer(rows[x][8], U), np.frombuffer(rows[y][8], U)
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    if 100 * common >= percent * (len(u) + len(v) - common):
                        above[max(p, q)] = min(p, q)
                        yield int(node[x]), int(node[y])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group: list[tuple] = []

            def out() -> pa.RecordBatch:
                uv = np.array(list(links(group)), np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], ["u", "v"])

            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if group and group[0][:3] != row[:3]:
                        yield out()
                        group = []
                    group.append(row)
            if group:
                yield out()

        met = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(V.lean(meet), "u long, v long")
        met = self.scratch.put(met, f"across-{self.turn}")
        self.scratch.drop(f"sets-{self.turn}")
        self.turn += 1
        return met


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS, scratch: Scratch | None = None, key_bits: int = 64) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z as a-z; sets hold the distinct runs of `k`
    words. Sets are linked if percent / 100 of their union is common. component_id is the
    smallest doc_id reachable, kept whether it is the document's own. Null, empty and blank
    texts have no shingles, no links and their own id; null ids keep a null component unless
    linked to others. Repeated rows are one node, and all of one id are kept or not together.
    Shingles are 64-bit hashes and sets are told apart by 64 + `key_bits` bits; where two share
    the first `key_bits` (of 2^34 sets about ten do; tests take fewer), one gets another number.
    Extra columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    table = scratch.put(nodes_of(docs, k, key_bits), "nodes")
    full = table.where("n_shingles > 0")
    # one row for each set: its smallest id stands for it, and the first half of its key is the node
    nodes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands"), F.min("bits").alias("bits"), F.count("*").alias("times"))
    nodes = scratch.put(nodes, "keyed")
    shared = nodes.groupBy("k1").agg(F.count("*").alias("n"), F.min("k2").alias("low")).where("n > 1")
    shared = nodes.select("k1", "k2").join(shared, "k1").where("k2 <> low").select("k1", "k2").orderBy("k1", "k2").collect()
    clash = {(r.k1, r.k2): int(V.mix(np.array([r.k1, r.k2], np.int64).view(U), i).sum(dtype=U).view(np.int64)) for i, r in enumerate(shared)}
    if clash:
        other = F.broadcast(docs.sparkSession.createDataFrame([(*x, y) for x, y in clash.items()], "k1 long, k2 long, other long"))
        numbered = lambda df: df.join(other, ["k1", "k2"], "left").withColumn("node", F.coalesce("other", "k1"))
    else:
        numbered = lambda df: df.withColumn("node", F.col("k1"))
    nodes = numbered(nodes).select("node", "doc_id", "bands", "bits", "times")
    buckets = scratch.put(buckets_of(nodes), "buckets")
    matcher = Matcher(docs, nodes, k, percent, miss, scratch, key_bits, clash)
    lead = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("_n")).where("a <> z")
    lead = scratch.put(lead, "lead")
    total = lead.agg(F.sum("_n")).first()[0] or 0
    stars = spread_join(buckets, lead.select("bucket", "a"), ["bucket"], lead, total).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    matcher.match(stars)
    # nodes of one bucket that no link has joined
    held = buckets.join(matcher.roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    held = scratch.put(held, "held")
    mixed = held.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("_n")).where("lo <> hi")
    mixed = scratch.put(mixed, "mixed")
    open_ = scratch.put(spread_join(held, mixed.select("bucket"), ["bucket"], mixed, total), "open")
    scratch.drop("held")
    if open_.head(1):
        matcher.add(matcher.across(open_))
    smallest = nodes.select("node", "doc_id").join(matcher.roots, "node").groupBy("root").agg(F.min("doc_id").alias("low"), F.count("*").alias("_n"))
    smallest = scratch.put(smallest, "smallest")
    n_nodes = nodes.count()
    of = spread_join(matcher.roots, smallest.select("root", "low"), ["root"], smallest, n_nodes).select("node", "low")
    known = nodes.select("node", "doc_id").join(of, "node", "left").select("node", F.coalesce("low", "doc_id").alias("component_id"))
    rows = numbered(table.where("n_shingles > 0").select("doc_id", "n_shingles", "k1", "k2")).select("doc_id", "n_shingles", "node")
    out = spread_join(rows, known, ["node"], nodes.select("node", F.col("times").alias("_n")), table.count())
    none = table.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("component_id"))
    out = out.select("doc_id", "n_shingles", "component_id").union(none)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
