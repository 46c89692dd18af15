"""The corpus pipeline as a whole against plain Python, with odd rows and clashing columns."""

import random

import numpy as np
import pytest

import corpus_pipeline
from gridfold.llm import decontaminate, packing, quality

from . import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, coverage double, _gone int, _id string, _text string"


def tables(spark, path):
    r = random.Random(11)
    good = lambda n: " ".join(r.choice(["the", "a", "rain", "walks", "over", "stone", "quiet"]) + r.choice(["", "s", "ed"]) + f"{r.randrange(99)}" for _ in range(n))
    texts = [good(r.randrange(30, 90)) for _ in range(70)]
    items = [good(25) for _ in range(6)]
    for i in range(8):
        texts.append(texts[i] + " tail")  # near copies
        texts.append("\n".join([texts[20 + i], "one more line " + str(i), texts[30]]))  # repeated lines
        texts.append("!!! $$$ BUY ### " * 20 + str(i))  # junk
    texts += [f"{good(20)} {x} {good(9)}" for x in items] + [None, "", " \n", texts[3], texts[3]]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 7, 0.1, 3, "x", "y") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("!!!" not in (t or "!!!"))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, labels, items


def test_equals_plain_python(spark, tmp_path):
    rows, labels, items = tables(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(r[0], r[1]) for r in rows]
    left = [(i, t) for (i, t), s in zip(left, model.scores([quality.terms_of(t or "") for _, t in left])) if s >= 0.7]
    n_good = len(left)
    cut = brute.without_repeated_lines(left)
    left = [(i, cut[i][2]) for i, _ in left if not cut[i][1] or (cut[i][2] or "").strip(" \t\n\r\x0b\x0c")]
    near = brute.components(left, 5, 80)
    left = [(i, t) for i, t in left if near[i] == i]
    n_apart = len(left)
    words = decontaminate.words_of
    left = [(i, t) for i, t in left if not any(brute.tiles(words(t or ""), words(x), 5)[1] / len(words(x)) >= 0.5 for x in items)]
    import public_tokenizers

    encode = packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, a, n) for i, t in left for a, n in packing.cut(len(encode(t or "")) + 1, 1024))
    assert len(rows) > n_good > n_apart > len(left) > 40
    assert sorted((r.doc_id, r.start, r.length) for r in got) == want


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            rows = {r.doc_id: r for r in docs.collect()}
            assert all(r[c] == rows[r.doc_id][c] for r in out.collect() for c in ("score", "_gone", "_id", "_text", "coverage", "predicted")), name
