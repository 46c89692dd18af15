"""Removal of repeated strings against brute force, with every way that a repeat can meet its other place."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridfold.llm import repeats
from gridfold.llm.marks import bitmap, bits_for


def brute_force(texts: list[bytes], length: int) -> list[tuple]:
    count = Counter(b[s : s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus() -> list[str]:
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(["rain", "été", "über", "stone", "walks", "a", "of", "mist"]) + str(r.randrange(40)) for _ in range(n))
    passages = [prose(n) for n in (12, 24, 30, 45, 90)]  # some shorter than the strings sought
    texts = [prose(r.randrange(80)) + r.choice(passages) + prose(r.randrange(80)) for _ in range(120)]
    texts += [texts[3]] * 40 + [texts[5] + "!", "!" + texts[5], "ab" * 400, "x" * 900, "x" * 199, "", texts[7] * 2]
    return texts


@pytest.mark.parametrize("shards, hot, copies", [(8192, 50_000, 1000), (3, 2, 1000), (3, 50_000, 10)])
def test_equals_brute_force(spark, monkeypatch, shards, hot, copies):
    monkeypatch.setattr(repeats, "REGIONS", shards)
    monkeypatch.setattr(repeats, "COPIES", copies)
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n int, t1 string")
    rows = sorted(repeats.remove_repeats(docs).collect())
    assert [tuple(r[1:]) for r in rows] == brute_force([t.encode() for t in texts], 200)


def test_one_row_stands_for_a_frequent_text():
    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["t1", "t2", "text", "row"])

    own = repeats.Pieces(200, {(1, 1): 5})
    got = own.fresh(batch((1, 1, "a", 4), (1, 1, "a", 5), (1, 1, "a", 5), (1, 2, "b", 4), (1, 2, "b", 9)))
    assert got.column(3).to_pylist() == [5, 4]
    assert own.fresh(batch((1, 1, "a", 5), (3, 1, "c", 5))).column(0).to_pylist() == [3]


def test_frequent_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(repeats, "COPIES", 2)
    texts = [*corpus()[:9], *[corpus()[3]] * 6]
    ids = [*range(9), 3, 3, None, None, 20, 21]
    rows = repeats.remove_repeats(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)).collect()
    want = [(i, *x) for i, x in zip(ids, brute_force([t.encode() for t in texts], 200))]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_kept_bytes_and_other_lengths(spark):
    texts = corpus()[::7] + [None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for length in (32, 77):
        rows = sorted(repeats.remove_repeats(docs, length, ("doc_id", "spans"), with_text=True).collect())
        assert [tuple(r[2:6]) for r in rows] == brute_force([(t or "").encode() for t in texts], length)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 5000)
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh") for _ in range(30_000))
    texts = [long + long[4900:5300], long[14_990:15_300], "z" + long[29_700:]]
    rows = sorted(repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [tuple(x[1:]) for x in rows] == brute_force([t.encode() for t in texts], 200)


def test_runs_meet_by_binary_search():
    def run(*keys):
        x = np.zeros(len(keys), repeats.DIGEST)
        x["d"], x["e"] = zip(*keys)
        return x

    hits = repeats.across([run((1, 1), (1, 2), (7, 0)), run((1, 2), (9, 9)), run((7, 1), (9, 9))])
    assert [h.tolist() for h in hits] == [[False, True, False], [True, True], [False, True]]


def test_bitmap(spark):
    keys = [1, 2, 2, 3, -5, -5, 1 << 60]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    for twice, want in ((False, {1, 2, 3, -5, 1 << 60}), (True, {2, -5})):
        marks = bitmap(df, bits_for(len(keys)), twice)
        assert int(np.unpackbits(marks).sum()) == len(want)
        assert repeats.marked(np.array(sorted(want)), marks).all()
