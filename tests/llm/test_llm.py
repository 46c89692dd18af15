"""The corpus operators on small fixtures, against brute force and known cases."""

import hashlib
import re
import zlib

import pytest

from gridfold.llm import decontaminate, fingerprints, license_scan, line_dedup, minhash, packing, pii, quality, repeats, url_filter
from gridfold.llm.common import Scratch

LONG = " ".join(f"w{i * 7919 % 9973}" for i in range(4000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again\nshort\nshort"),
    (2, "the quick brown fox jumps over the lazy cat again\nother line"),
    (3, None), (4, ""), (5, " \n\t "), (6, LONG), (6, LONG), (7, LONG + " tail"), (8, "été ÉTÉ \U0001f600 MIT"),
    (9, "a " + PASSAGE), (10, PASSAGE + " b"), (11, "x"), (None, "the quick brown fox jumps over the lazy dog again"),
]
SCHEMA = "doc_id long, text string, score double, k1 string, n string, lines string, path string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.0, "k", "n", "l", "p") for r in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int"
ITEMS = "item_id long, text string"


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (None, 1), (6, 1), (6, 0)], LABELS)
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (None, "x y z"), (3, "")], ITEMS)
    return {
        "quality": lambda d: quality.score_quality(d, quality.train(d, labels)),
        "lines": line_dedup.dedup_lines,
        "license": license_scan.scan_licenses,
        "minhash": minhash.near_duplicates,
        "fingerprints": lambda d: fingerprints.fingerprint_documents(d, Scratch(spark)),
        "pii": lambda d: pii.pseudonymize(d, b"k"),
        "packing": packing.pack,
        "repeats": repeats.remove_repeats,
        "decontaminate": lambda d: decontaminate.decontaminate(d, items),
    }


@pytest.mark.parametrize("name", ["quality", "lines", "license", "minhash", "fingerprints", "pii", "packing", "repeats", "decontaminate"])
def test_odd_rows_and_empty_tables(spark, docs, none, name):
    f = operators(spark)[name]
    rows = f(docs).collect()
    assert len(rows) == len(TEXTS) or name == "packing" and len(rows) > len(TEXTS)
    assert f(none).collect() == []


def test_line_dedup(docs):
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert rows[None].n_removed == 0  # null ids come first
    assert rows[1].text == "short" and rows[1].n_removed == 2
    assert rows[2].text == "other line"  # 7 of 8 words
    assert rows[3].text is None and rows[4].text == "" and rows[5].text == " \n\t "


def test_line_dedup_equals_brute_force(spark):
    import random

    r = random.Random(4)
    texts = [(i, "\n".join(" ".join(r.choice("abcdefghijklmnopq") for _ in range(r.choice([1, 3, 4, 5, 9, 30]))) for _ in range(6))) for i in range(120)]
    seen, want = [], {}
    for i, t in texts:
        gone = 0
        for line in t.split("\n"):
            s = set(line.split())
            gone += any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
            seen.append(s)
        want[i] = gone
    got = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_removed for x in got} == want


def test_minhash(docs):
    rows = [r for r in minhash.near_duplicates(docs).collect()]
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id in (3, 4, 5)} == {(3, 3, True), (4, 4, True), (5, 5, True)}
    assert minhash.least_matches(0.85, 1e-6, 120, 20)[-1][1] < 102


def test_license_expressions():
    post = license_scan.to_postfix("MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0) and more")
    assert license_scan.evaluate(post)[0] >= {"mit", "apache-2", "gpl"}
    assert license_scan.to_postfix("MIT AND") == ["MIT"] and license_scan.to_postfix("AND") is None
    a = license_scan.automaton({p: (x, True) for p, x in license_scan.BASE_PHRASES.items()})
    text = "Under the MIT License! x cc by-nc é under the mit license"
    assert license_scan.scan_text(text, a)[:6] == (13, 3, 0, 9, "cc-by-nc,mit", "cc-by-nc,mit")


def test_packing_is_a_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs.where("doc_id = 7 or doc_id = 8"), with_ids=True).collect()
    for i, text in ((7, LONG + " tail"), (8, TEXTS[8][1])):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert all(r.length & (r.length - 1) == 0 and r.offset == 0 and r.ids_crc32 == zlib.crc32(r.ids) for r in own)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json"))("a <|endoftext|> b") == t.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_url_rules(spark):
    rows = [(1, "http://a.Example.com/en/x?q"), (2, None), (3, "no scheme"), (4, "http://www.example.com/en/"), (5, "http://net/fr/"), (5, "http://net/fr/"), (6, "http://xexample.net"), (7, "://")]
    rules = [url_filter.Rule.parse("block", "example.com/en/"), url_filter.Rule.parse("allow", "www.example.com/en/"), url_filter.Rule.parse("block", "net/fr/")]
    got = [(r.page_id, r.rule, r.verdict) for r in url_filter.filter_pages(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()]
    assert sorted(got) == sorted([(1, "example.com/en/", "block"), (2, None, "allow"), (3, None, "allow"), (4, "www.example.com/en/", "allow"), (5, "net/fr/", "block"), (5, "net/fr/", "block"), (6, None, "allow"), (7, None, "allow")], key=lambda x: x)


@pytest.mark.parametrize("regions", [8192, 1])
def test_repeats_equal_brute_force(spark, docs, monkeypatch, regions):
    monkeypatch.setattr(repeats, "REGIONS", regions)
    texts = [((t or "").encode()) for _, t in TEXTS]
    count: dict[bytes, int] = {}
    for b in texts:
        for s in range(len(b) - 199):
            count[b[s : s + 200]] = count.get(b[s : s + 200], 0) + 1
    want = []
    for (i, _), b in zip(TEXTS, texts):
        gone = {p for s in range(len(b) - 199) if count[b[s : s + 200]] > 1 for p in range(s, s + 200)}
        want.append((i, len(b), len(gone), hashlib.sha256(bytes(c for p, c in enumerate(b) if p not in gone)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tiling_catches_reordered_passages():
    index = decontaminate.Index([(1, PASSAGE)], 5)
    w = PASSAGE.split()
    tiles = index.tiles(" ".join(w[30:] + ["zz"] + w[:30]))
    assert tiles == [(0, 2, 60, 60)]
    assert index.tiles("nothing of it at all here") == []


def test_surrogates():
    text = "a.b@c.example.org A.B@C.EXAMPLE.ORG 192.168.1.7 4845168114407329"
    out = [(k, c, pii.surrogate(k, c, b"k")) for *_, k, c in pii.find(text)]
    assert out[0][2] == out[1][2] and all(c != s for _, c, s in out)
    assert pii.luhn("79927398713") == 0 and out[3][0] == "card" and pii.luhn(out[3][2]) == 0
    assert [*pii.find("number 4845168114407328, 4845-1681-1440-7328 or 48451681144073")] == []  # wrong check digits
    p = pii.Permutation(b"k", "x", 97)
    assert sorted(map(p, range(97))) == list(range(97)) and all(p(i) != i for i in range(97))
    assert re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", pii.written("phone", "+1 (017) 555-7713", pii.surrogate("phone", "10175557713", b"k")))


@pytest.mark.parametrize("radius", [3, 19, 23])
def test_search_equals_brute_force(spark, radius):
    import random

    r = random.Random(radius)
    prints = {r.getrandbits(128) for _ in range(40)}
    for x in sorted(prints):
        prints |= {x ^ sum(1 << b for b in r.sample(range(128), n)) for n in (1, radius - 1, radius, radius + 1)}
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    two = {(signed(x >> 64), signed(x & (1 << 64) - 1)): x for x in prints}
    every = spark.createDataFrame([(*k, 1) for k in two], "hi long, lo long, times int")
    asked = spark.createDataFrame([k for k, x in two.items() if x % 3], "q_hi long, q_lo long")
    got = [(two[x.q_hi, x.q_lo], two[x.hi, x.lo]) for x in fingerprints.within(asked, every, radius).collect()]
    want = [(q, x) for q in prints if q % 3 for x in prints if (q ^ x).bit_count() <= radius]
    assert sorted(got) == sorted(want)


def test_near_copies_are_counted(spark):
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    base = [word() for _ in range(300)]
    texts = [(0, " ".join(base)), (20, " ".join(word() for _ in range(300)))]
    for i in range(1, 9):  # 8 words changed: 3-word Jaccard about 0.85
        copy = list(base)
        for at in r.sample(range(300), 8):
            copy[at] = word()
        texts.append((i, " ".join(copy)))
    got = fingerprints.fingerprint_documents(spark.createDataFrame(texts, "doc_id long, text string"), Scratch(spark)).collect()
    assert {x.doc_id: x.n_near for x in got if x.n_near is not None} == {0: 9, 20: 1}


def test_more_names_than_short_surrogates(spark, monkeypatch):
    monkeypatch.setattr(pii, "SYLLABLES", {"latin": ("ba", "de") * 8})  # 16 of four syllables
    names = [f"{a}{b}xyz" for a in "ABCDEFG" for b in "abcdef"]
    texts = [(i, " and ".join(f"Mr {x}" for x in names[i::3])) for i in range(3)]
    rows = pii.pseudonymize(spark.createDataFrame(texts, "doc_id long, text string"), b"k").collect()
    new = [x for r in rows for x in re.findall(r"Mr (\w+)", r.text)]
    assert len(new) == len(set(new)) == len(names) and not set(new) & set(names)


def test_whole_secrets(spark):
    secrets = ["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P", "wJalr/XUtnFEMI+K7MDENG/bPxRfiCY+EXAMPLEKEY==", "SG.ngeVfQFYQlKU0ufo.x5d1-2_q", "Zk9" * 700, "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"]
    for x in secrets:
        text = f"api_key: {x}. And so on"
        assert [(k, c) for *_, k, c in pii.find(text)] == [("secret", x)]
        new = pii.surrogate("secret", x, b"k")
        assert len(new) == len(x) and not any(new[i : i + 12] == x[i : i + 12] for i in range(len(x) - 12))
    row = pii.pseudonymize(spark.createDataFrame([(1, "token=" + secrets[3])], "doc_id long, text string"), b"k").first()
    assert row.n_entities == 1 and row.text == "token=" + pii.surrogate("secret", secrets[3], b"k")
    assert [*pii.find("token = self.tokenizer.encode(x)")] == []


def test_license_tags_come_from_the_automaton():
    a = license_scan.automaton({p: (x, True) for p, x in license_scan.BASE_PHRASES.items()})
    assert license_scan.TAG_WORDS in a
    long = "é\U0001f600 SPDX-License-Identifier: " + " OR ".join(["MIT"] * 100 + ["MPL-2.0"]) + "\nor GPL-2.0"
    assert license_scan.scan_text(long, a)[5] == "mit,mpl"  # beyond 400 characters, not beyond the line
    two = "spdx license identifier: ISC \\nSPDX-License-Identifier: (BSD-3-Clause AND GPL-2.0-only) */\n# spdx-license-identifier:MIT-0 or"
    assert license_scan.scan_text(two, a)[5] == "bsd,gpl,mit"
    assert license_scan.scan_text("spdx-license-identifier", a)[5] == ""


def test_lines_beyond_two_million():
    import numpy as np

    data = np.frombuffer(b"a b c d" + b"\n" * (1 << 21) + b"e f g h", np.uint8)
    lines = line_dedup.Lines(data, np.array([0, len(data)]), np.arange(line_dedup.BUCKETS, dtype=np.uint32))
    assert lines.size.tolist() == [4, 4] and lines.number.tolist() == [0, 1 << 21]


def test_votes_keep_the_mix_of_all_labels(spark):
    rows = [(i, "same words here") for i in range(200)]
    labels = [(i, int(i % 10 > 0)) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    few = quality.train(docs, labels, 16)  # half of each class; 9 in 10 of all are good
    bag = [quality.terms_of("same words here")]
    share = labels.where(~quality.held_out(labels.doc_id)).agg({"quality": "avg"}).first()[0]
    assert abs(few.scores(bag)[0] - share) < 0.2 and abs(few.prior - share) < 1e-6
