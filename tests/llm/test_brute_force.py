"""The queries' results on small tables against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.llm import common, decontaminate, fingerprints, license_scan, line_dedup, minhash, packing, pii, quality
from gridfold.llm import queries as Q
from gridfold.llm.common import Scratch

from . import brute

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect())


def test_classifier_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in common.table(spark, MIDDLE, "labels").collect()}
    rows = [r for r in Q.op1_quality_classifier(spark, MIDDLE).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == labels[r.doc_id] for r in held) / len(held)
    often = max(np.bincount([labels[r.doc_id] for r in held])) / len(held)
    assert right > max(0.95, often) and all(r.predicted == (r.score >= 0.7) for r in rows)


def test_votes_equal_brute_force():
    r = random.Random(3)
    texts = [" ".join(r.choice(["good", "fine", "spam", "!!!", "x1"]) for _ in range(r.randrange(1, 30))) for _ in range(60)]
    bags = [quality.terms_of(t) for t in texts]
    model = quality.fit(bags[:40], np.array([i % 3 > 0 for i in range(40)], np.float64), rank=8, neighbours=5, per_class=(1.0, 2.0))
    x = quality.unit(quality.weigh(bags, model.weights) @ model.axes)
    for i, got in enumerate(model.scores(bags)):
        near = sorted(((float(x[i] @ v), j) for j, v in enumerate(model.vectors)), reverse=True)
        voters = [(c, j) for c, j in near if c >= near[4][0] - quality.TIE]
        w = {j: max(c, 0) ** 4 * model.votes[j] for c, j in voters}
        assert got == pytest.approx(sum(v * model.labels[j] for j, v in w.items()) / sum(w.values()), abs=1e-4)
    assert (model.scores(bags[:7] * 3)[:7] == model.scores(bags[:7])).all()


def test_licenses_equal_brute_force(spark, documents):
    labels = {tuple(p.split()): x for p, x in license_scan.BASE_PHRASES.items()}
    long = "x " * 200_000 + "Under the MIT License"
    odd = [(900_001, "under the mit license under the MIT license"), (900_002, None), (900_003, long), (900_004, "cc-by-nc é apache license, version 2")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(documents + odd, "doc_id long, text string")).collect()}
    for i, text in documents + odd:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
        places = [(a, x) for p, x in labels.items() for a in range(len(words) - len(p) + 1) if tuple(words[a : a + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def near_texts():
    r = random.Random(8)
    word = lambda: f"w{r.randrange(3000)}"
    rows = []
    for family in range(12):
        base = [word() for _ in range(r.choice([2, 9, 40, 120]))]
        for _ in range(9):
            text = list(base)
            for _ in range(r.randrange(5)):
                text[r.randrange(len(text))] = word()
            rows.append(" ".join(text))
    return [*rows, *rows[:5], None, "", " \n", "one", "ONE", "one two"]


@pytest.mark.parametrize("k, percent, bits", [(3, 85, 64), (5, 80, 64), (3, 85, 3)])
def test_near_duplicates_equal_brute_force(spark, k, percent, bits):
    rows = [(7 * i % 1009, t) for i, t in enumerate(near_texts())]
    docs = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, text string, node int, k1 double")
    got = minhash.near_duplicates(docs, k, percent, key_bits=bits).collect()
    want = brute.components(rows, k, percent)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(brute.shingles(dict(rows)[r.doc_id], k)) for r in got)


def test_a_hub_of_many_copies(spark, monkeypatch):
    for module in (minhash, common):
        monkeypatch.setattr(module, "GROUP", 100)
        monkeypatch.setattr(module, "MANY", 20)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:-1] + [f"x{i % 1500}"])) for i in range(5000)] + [(5000 + i, f"a lonely text {i}") for i in range(50)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: 0 if i < 5000 else i for i, _ in rows}


def test_near_duplicates_of_the_small_table(spark, documents):
    got = {r.doc_id: r.component_id for r in Q.op4_minhash_dedup(spark, SMALL).collect()}
    assert got == brute.components(documents, 3, 85)


def test_fingerprints_equal_brute_force(spark, documents):
    got = {r.doc_id: r for r in Q.op5_fingerprints(spark, SMALL).collect()}
    assert len(got) == len(documents)
    for at, (i, text) in enumerate(documents):
        text, (after, next_) = text or "", documents[(at + 1) % len(documents)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (next_ or "")[:half]
        r = got[i]
        bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (bits(r.fingerprint, r.edited_fingerprint), bits(r.fingerprint, got[after].fingerprint))
        if i % 20 == 0:
            assert r.n_near == sum((int(r.fingerprint, 16) ^ int(x.fingerprint, 16)).bit_count() <= fingerprints.RADIUS for x in got.values())


def test_ranges_of_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    rows = [(i * i, f"text {i}") for i in range(50)] + [(None, "a"), (None, "b"), (49, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, bounds = fingerprints.in_ranges(docs)
    assert len(bounds) > 5
    for r in dealt.collect():
        assert r._range == (0 if r.doc_id is None else max(sum(x <= r.doc_id for x in bounds) - 1, 0))
    got = fingerprints.fingerprint_documents(docs, Scratch(spark)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(i + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest() for i, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in got) == want


def test_names_belong_together(spark):
    text = "Mr John Smith met Mr Smith and John Smith. Dr Ann Lee Park, SMITH's aunt, saw Mr Иванов. Ms O'Neil-Ray and Smithson left; call +1 (017) 555-7713 or (017) 555-7713."
    rows = [(1, text), (2, "Frau Smith"), (3, "john smith goes " * 3)]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    new = got[1].text
    given, family = re.match(r"Mr (\w+) (\w+) met", new).groups()
    assert f"met Mr {family} and {given} {family}." in new and f"{family.upper()}'s aunt" in new and given.endswith("n")
    assert re.search(r"Dr [A-Z]\w+ [A-Z]\w+ [A-Z]\w+, ", new) and "Park" not in new and "Lee" not in new
    assert re.search(r"saw Mr [А-Я][а-я]+ов\.", new) and re.search(r"Ms [A-Z][a-z]+'[A-Z][a-z]+-[A-Z][a-z]+ and Smithson", new)
    one, two = re.findall(r"\((\d{3}\) \d{3}-\d{4})", new)
    assert one == two != "017) 555-7713" and "+1 (" in new
    assert got[2].text == f"Frau {family}" and got[3].text == rows[2][1] and got[3].n_entities == 0
    assert got[1].n_entities == 9


def test_accounts_and_long_entities(spark):
    iban, name = "DE89 3704 0044 0532 0130 00", "A" + "bc" * 300
    text = f"{iban} and DE89370400440532013000, DE88370400440532013000; 123-45-6789; Mr {name}; {'x' * 3000}@example.org"
    out = [(k, c) for *_, k, c in pii.find(text)]
    assert [k for k, _ in out] == ["iban", "iban", "ssn", "name", "email"] and out[0] == out[1]
    new = pii.surrogate("iban", out[0][1], b"k")
    assert pii.remainder(new) == 1 and new[:2] == "DE" and new != out[0][1]
    assert pii.written("iban", iban, new).replace(" ", "") == new and pii.written("iban", iban, new)[4] == " "
    changed = pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").first().text
    assert name[1:40] not in changed and "x" * 20 not in changed and re.search(r"; \d{3}-\d{2}-\d{4};", changed)


def test_packing_of_every_document(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(900_001, " " * 1_000_000 + "x"), (900_002, "\n" * 300_000), (900_003, "a" * 300_000), (900_004, None), (900_005, "")]
    rows = packing.pack(spark.createDataFrame(documents + odd, "doc_id long, text string"), with_ids=True).collect()
    own = {}
    for r in sorted(rows, key=lambda r: r.start):
        own.setdefault(r.doc_id, []).append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 and r.ids_crc32 == zlib.crc32(r.ids)
    for i, text in documents + odd:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert b"".join(bytes(r.ids) for r in own[i]) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in own[i]] == np.cumsum([0] + [r.length for r in own[i]])[:-1].tolist() and {r.doc_tokens for r in own[i]} == {len(ids)}
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_tilings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEEDS", 50)
    r = random.Random(2)
    word = lambda: r.choice("abcd")
    items = [[word() for _ in range(r.randrange(3, 40))] for _ in range(12)]
    docs = [[word() for _ in range(r.randrange(60))] + items[i % 12] for i in range(30)] + [list("ab" * 40), []]
    index = decontaminate.Index([(i, " ".join(x)) for i, x in enumerate(items)], 4)
    for d in docs:
        got = {index.names[i]: rest for i, *rest in index.tiles(" ".join(d))}
        for i, item in enumerate(items):
            n, covered = brute.tiles(d, item, 4)
            # ties between matches of one length may cut what is left otherwise
            assert got.get(i, [0, 0, len(item)])[1] == pytest.approx(covered, abs=0 if n < 2 else 4)


def test_a_phrase_that_recurs_in_both(monkeypatch):
    index = decontaminate.Index([(1, "a b c " * 2000)], 5)
    found, doc = index.matches("a b c " * 2000)
    assert len(found) < 5000 and index.tiles("a b c " * 2000) == [(0, 1, 6000, 6000)]


def test_benchmark_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(30))) for i in range(40)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in items] + [(99, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.decontaminate(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert sorted(decontaminate.decontaminate(docs, bench).collect()) == whole
    assert [r.best_item for r in whole[:40]] == [*range(40)] and whole[0].contaminated and not whole[-1].contaminated


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e\nnew", 1, 2, 3), (2, "a b c d e", 4, 5, 6)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, _gone int, _id int, k1 int"))
    assert sorted(map(tuple, out.collect())) == [(1, "a b c d e\nnew", 1, 2, 3, 2, 0), (2, "", 4, 5, 6, 1, 1)]


def test_spread_join(spark):
    big = spark.createDataFrame([(i % 7 and i % 50, i) for i in range(3000)], "k long, v long")
    small = spark.createDataFrame([(i, -i) for i in range(40)], "k long, w long")
    counts = big.groupBy("k").agg(F.count("*").alias("_n"))
    common_rows = sorted(map(tuple, big.join(small, "k").collect()))
    old, common.GROUP = common.GROUP, 50
    try:
        assert sorted(map(tuple, common.spread_join(big, small, ["k"], counts, 3000).collect())) == common_rows
    finally:
        common.GROUP = old
