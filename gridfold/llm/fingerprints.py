"""SimHash fingerprints and Hamming search, in DataFrame functions only.

Terms are pairs of neighbouring words, weighted by their letters up to a bound, so that pairs
of short common words count little. Each of a term's 128 hash bits votes with the weight, up
or down; three bits' counts share one long, which halves twice the number of sums. A
fingerprint is two longs, shown as 32 hexadecimal digits.

Fingerprints within `radius` bits differ little in at least one block of 16 bits: at radius 23
in at most 2 of its bits. A table for each block, keyed by its bits, is asked for the bits of
the query and for all that differ from them as little, which finds all of them by equi-joins.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import release, whole_text

BITS = 128
#: Largest weight of a term, and terms whose votes share a sum: their product is below 2^21.
WEIGHT, RUN = 16, 1 << 16
LANES, LANE = 3, 21
#: From measured distances (README): near copies lie within it, unrelated texts well beyond.
RADIUS = 23
#: Bits of a block, the key of a table.
BLOCK = 16
#: Rows of a range of ids, and ranges at most: their bounds are 8 MB then, and beyond 2^31 rows
#: ranges grow (a task sorts a range on disk if need be).
RANGE_ROWS, RANGES = 2048, 1 << 20


def votes(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The fingerprint (hi, lo) of each row; `key` columns tell rows apart."""
    words = F.split(F.lower(F.col(text)), r"\s+")
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))
    terms = texts.select(*key, F.posexplode(pairs).alias("_at", "_t"))
    a, b = F.col("_t").getField("a"), F.col("_t").getField("b")
    terms = terms.select(
        *key,
        F.shiftright("_at", 16).alias("_run"),
        F.xxhash64(a, b).alias("_h0"),
        F.xxhash64(b, a, F.lit(7)).alias("_h1"),
        F.least(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(WEIGHT)).cast("long").alias("_w"),
    )
    sums = [F.sum("_w").alias("_w")]
    for h in range(BITS // 64):
        for first in range(0, 64, LANES):
            lanes = [F.shiftleft(F.shiftright(f"_h{h}", first + i).bitwiseAND(F.lit(1)), LANE * i) for i in range(min(LANES, 64 - first))]
            packed = lanes[0]
            for x in lanes[1:]:
                packed = packed.bitwiseOR(x)
            sums.append(F.sum(F.col("_w") * packed).alias(f"_s{h}_{first}"))
    runs = terms.groupBy(*key, "_run").agg(*sums)

    def up(h: int, bit: int) -> Column:
        first = bit - bit % LANES
        return F.shiftright(f"_s{h}_{first}", LANE * (bit - first)).bitwiseAND(F.lit((1 << LANE) - 1))

    # a text of more than RUN terms has several runs
    total = runs.groupBy(*key).agg(F.sum("_w").alias("_w"), *(F.sum(up(h, bit)).alias(f"_n{h}_{bit}") for h in range(BITS // 64) for bit in range(64)))

    def word(h: int) -> Column:
        out = F.lit(0).cast("long")
        for bit in range(64):
            out = out.bitwiseOR(F.when(F.col(f"_n{h}_{bit}") * 2 > F.col("_w"), F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return total.select(*key, word(0).alias("hi"), word(1).alias("lo"))


def show(hi: str, lo: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (hi, lo))))


def distance(a: tuple, b: tuple) -> Column:
    """Bits in which two (hi, lo) differ."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)), F.lit(0))


def allowances(radius: int) -> list[int]:
    """The bits by which each block may differ, -1 where it is not needed: fingerprints beyond
    all of them differ in at least the sum of (allowance + 1), which is radius + 1."""
    blocks = BITS // BLOCK
    return [(radius + 1 + blocks - 1 - i) // blocks - 1 for i in range(blocks)]


def within(queries: DataFrame, all_: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of `all_` (hi, lo and others) with the (q_hi, q_lo) of all queries within `radius`
    bits, itself included.

    Both sides are distinct fingerprints. A pair that several blocks show comes from the first
    of them only. The key of a table is its block's number and bits; a query has a row for each
    of the keys that its allowance reaches, the others one row a table.
    """
    used = [(i, t) for i, t in enumerate(allowances(radius)) if t >= 0]

    def block(hi: str, lo: str, i: int) -> Column:
        c, at = (hi, i) if i < 64 // BLOCK else (lo, i - 64 // BLOCK)
        return F.shiftrightunsigned(c, BLOCK * at).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int")

    def keys(hi: str, lo: str, tables: list[int]) -> Column:
        return F.explode(F.array(*(block(hi, lo, i).bitwiseOR(F.lit(i << BLOCK)) for i in tables))).alias("key")

    def asked(most: int) -> DataFrame:
        flips = [sum(1 << x for x in c) for n in range(most + 1) for c in combinations(range(BLOCK), n)]
        own = queries.select("q_hi", "q_lo", keys("q_hi", "q_lo", [i for i, t in used if t == most]))
        own = own.select("q_hi", "q_lo", "key", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
        return own.select("q_hi", "q_lo", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))

    asks = [asked(t) for t in sorted({t for _, t in used})]
    every = all_.select("*", keys("hi", "lo", [i for i, _ in used]))
    # not broadcast: the rows of either side are many more than their sources' sizes tell
    found = every.join((asks[0] if len(asks) == 1 else asks[0].unionByName(asks[1])).hint("merge"), "key")
    first = F.coalesce(*(F.when(F.bit_count(block("hi", "lo", i).bitwiseXOR(block("q_hi", "q_lo", i))) <= t, F.lit(i)) for i, t in used))
    near = (distance(("hi", "lo"), ("q_hi", "q_lo")) <= radius) & (F.shiftright("key", BLOCK) == first)
    return found.where(near).select("q_hi", "q_lo", *all_.columns)


def in_ranges(docs: DataFrame) -> tuple[DataFrame, list[int]]:
    """`docs` with `_range`, the number of its range of ids, and the first id of each range.

    Bounds are quantiles that occur as ids, so no range is empty; null ids are in the first.
    """
    n, low = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    if not n:
        return docs.withColumn("_range", F.lit(0)), []
    parts = max(1, min(RANGES, n // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = sorted({low, *cuts})
    # the number of bounds up to an id, by binary search: a step for each bit of the answer
    known = F.from_json(F.lit(str([-(1 << 63), *bounds[1:]])), "array<bigint>")
    bits = [1 << i for i in reversed(range((len(bounds)).bit_length()))]
    at = F.aggregate(
        F.array(*map(F.lit, bits)),
        F.lit(0),
        lambda low, step: F.when((low + step < len(bounds)) & (F.get(known, low + step) <= F.col("doc_id")), low + step).otherwise(low),
    )
    return docs.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(at)), bounds


def edited_prints(docs: DataFrame) -> tuple[DataFrame, int]:
    """One row per row of `docs`, its place (_range, _n), doc_id, n_chars, edited_sha256, and the
    fingerprints of its text (hi, lo) and its edited text (e_hi, e_lo); and the last range.

    Rows follow each other by doc_id (null ids first, equal ids by text); after the last comes
    the first. The edited text has its last floor(n_chars / 2) characters replaced by as many
    of the next row's first ones. Null texts are empty; a text without words has the
    fingerprint zero. Repeated rows each have their own. Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    dealt, bounds = in_ranges(docs)
    last = max(len(bounds), 1) - 1
    # the first row of each range also stands, as an extra one, behind the last of the range before
    order = "PARTITION BY _range ORDER BY _extra, doc_id NULLS FIRST, text"
    dealt = dealt.withColumn("_extra", F.lit(0))
    begins = dealt.where(F.col("doc_id").isNull() | F.col("doc_id").isin(bounds)) if bounds else dealt
    begins = begins.select("*", F.expr(f"row_number() OVER ({order})").alias("_n")).where("_n = 1").drop("_n")
    begins = begins.withColumns({"_range": F.when(F.col("_range") == 0, last).otherwise(F.col("_range") - 1), "_extra": F.lit(1)})
    rows = dealt.unionByName(begins)
    both = rows.select("*", F.expr(f"row_number() OVER ({order})").alias("_n"), F.expr(f"lead(text) OVER ({order})").alias("_next")).where("_extra = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("_next", F.lit(1), half))
    both = both.select("_range", "_n", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("_edited"))
    key = ["_range", "_n", "doc_id", "n_chars", "edited_sha256", "_kind"]
    two = both.select("_range", "_n", "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "_edited")).alias("_kind", "text"))
    prints = votes(two, key)
    pick = lambda c, k: F.max(F.when(F.col("_kind") == k, F.col(c)))
    prints = prints.groupBy(*key[:-1]).agg(pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"), pick("hi", 1).alias("e_hi"), pick("lo", 1).alias("e_lo"))
    return prints, last


def fingerprint_documents(docs: DataFrame, scratch, radius: int = RADIUS, query_every: int = 20) -> DataFrame:
    """One row per row of `docs` (see `edited_prints`) with fingerprints as digits; near_edited
    and near_next, the share of bits that the fingerprint has in common with the edited text's
    and the next row's; and n_near: for ids divisible by `query_every` how
    many rows, itself included, have a fingerprint within `radius` bits; null for other ids."""
    prints, last = edited_prints(docs)
    prints = scratch.put(prints, "prints")
    release(scratch.spark)  # the texts' shuffle files, held until `prints` was bound anew
    order = "PARTITION BY _range ORDER BY _n"
    rows = prints.select("*", *(F.expr(f"lead({c}) OVER ({order})").alias(f"n_{c}") for c in ("hi", "lo")))
    begins = prints.where("_n = 1").select(F.when(F.col("_range") == 0, last).otherwise(F.col("_range") - 1).alias("_range"), F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"))
    rows = rows.join(begins, "_range", "left").withColumns({"n_hi": F.coalesce("n_hi", "b_hi"), "n_lo": F.coalesce("n_lo", "b_lo")})
    every = prints.groupBy("hi", "lo").agg(F.count("*").alias("times"))
    asked = prints.where(F.col("doc_id") % query_every == 0).select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).distinct()
    near = within(asked, every, radius).groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("times").alias("n_near"))
    rows = rows.join(near, ["hi", "lo"], "left")
    like = lambda a, b: (1 - distance(("hi", "lo"), (a, b)) / F.lit(float(BITS))).cast("double")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", show("hi", "lo").alias("fingerprint"), show("e_hi", "e_lo").alias("edited_fingerprint"),
        like("e_hi", "e_lo").alias("near_edited"), like("n_hi", "n_lo").alias("near_next"),
        F.when(F.col("doc_id") % query_every == 0, F.col("n_near")).alias("n_near"),
    )
