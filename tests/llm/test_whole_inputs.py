"""Whole words, whole pages, components beyond doubles, texts of some MB."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import language, lmscore, media, mixing, neardup, pieces, quality, sharding, tokenfile, topk

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("n", [255, 256, 257, 600, 100_000])
def test_a_word_is_one_word_however_long(n):
    make = quality.Featurizer(18)
    at, x = make.vector("a" * n)
    assert len(at) == len(make.vector("a")[0]) == 2 and x.sum() == pytest.approx(1)
    long = make.vector("x " + "ab" * n + " y z")
    assert len(long[0]) == len(make.vector("x ab y z")[0]) and all((a == b).all() for a, b in zip(long, quality.Featurizer(18).vector("x " + "ab" * n + " y z"), strict=True))
    assert make.codes(["b" * n])[0] & np.uint64(0xFFFFFFFF) == zlib.crc32(b"b" * n)


def said(page):
    return [(p["kind"][0], p["text"] or p["ref"], p["caption"]) for p in media.sequence(page)]


def test_open_elements_hide_nothing():
    assert said("<figure><img src=a><figcaption>cap<p>rest of the page text</p>") == [("m", "a", "cap"), ("t", "rest of the page text", None)]
    assert said("<figure><img src=a><figcaption>cap") == [("m", "a", "cap")]
    assert said("<figcaption>one<figure><img src=b></figure> two") == [("t", "one", None), ("m", "b", None), ("t", " two", None)]
    assert said("<p>a<noscript><p>b<img src=q>") == [("t", "a", None), ("t", "b", None), ("m", "q", None)]
    assert said("a<noscript>b<img src=q></noscript>c<script>x<y") == [("t", "ac", None)]
    assert said("a<template><noscript>b</template>c</noscript>") == [("t", "ac", None)]


def test_figures_inside_figures_keep_their_captions():
    assert said("<figure><img src=a><figure><img src=b><figcaption>B</figcaption></figure><figcaption>A</figcaption></figure>x") == [("m", "a", "A"), ("m", "b", "B"), ("t", "x", None)]
    assert said("<figure><figcaption>A <b>bold</b></figcaption><figure><img src=b alt=t></figure><img src=c></figure>") == [("m", "b", "A bold"), ("m", "c", "A bold")]
    assert said("<figure><figure><img src=b alt=t></figure></figure>") == [("m", "b", "t")]


def test_parts_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {}
    for r in media.parts_of(pages, "page_id").collect():
        got.setdefault(r["page_id"], []).append({c: r[c] for c in ("pos", "kind", "text", "ref", "caption")})
    for r in pages.collect():
        assert sorted(got.get(r["page_id"], []), key=lambda p: p["pos"]) == media.sequence(r["html"])


def test_scores_beyond_doubles(spark):
    rows = [(0, [1e307, 1.0]), (20, [-1e307, 0.5]), (1, [1e308, 0.0]), (2, [0.5, 0.5]), (3, [1e300, -1e300]), (4, [-1e-300, 2.0])]
    got = topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    q = {i: [int(v) * 64 if abs(v) > 2**53 else int(np.floor(v * 64)) for v in x] for i, x in rows}
    want = []
    for i in (0, 20):
        scores = sorted(((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q[i], q[j], strict=True)))), j) for j in q if j != i), key=lambda s: (-s[0], s[1]))
        want += [(i, n + 1, j, s) for n, (s, j) in enumerate(scores[:3])]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.fixture(scope="module")
def long_docs(spark):
    draw = random.Random(2)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.choice([2, 3, 5, 8]))) for _ in range(900)]
    long = " ".join(draw.choice(vocabulary) for _ in range(400_000))
    texts = [long, long + " and more", "w" * 2_000_000, "short one", None]
    return spark.createDataFrame([(i, t, "en", f"src{i % 2}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_texts_of_some_mb(spark, long_docs):
    rows = {r["doc_id"]: r["text"] or "" for r in long_docs.collect()}
    shards = {r["doc_id"]: r for r in sharding.shard(long_docs, 3).collect()}
    assert all(shards[k]["size"] == len(t.encode()) + 16 for k, t in rows.items())
    scored = {r["k"] if "k" in r else r["doc_id"]: r for r in lmscore.score(long_docs, F.lit(True)).collect()}
    assert all(scored[k]["n_tokens"] == len(t.split()) + 1 and np.isfinite(scored[k]["score"]) for k, t in rows.items())
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(long_docs, size=5, percent=80).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    picked = {r["doc_id"]: r["n_tokens"] for r in mixing.pick(long_docs, F.lit("d"), share=1.0, epochs=1).collect()}
    assert picked == {k: len(t.split()) + 1 for k, t in rows.items()}
    parts = media.parts_of(media.pages_of(long_docs), "doc_id").where("kind = 'media'")
    assert {r["doc_id"]: r["n_bytes"] for r in media.resolve(parts, media.measure(media.store_of(long_docs))).collect()} == {k: len(t.encode()) for k, t in rows.items()}
    model = quality.train(long_docs, spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int"), F.lit(True))
    assert quality.score(long_docs, model).count() == 5 and language.identify(long_docs, language.train(long_docs, F.lit(True))).count() == 5


def test_ids_of_texts_of_some_mb(spark, long_docs):
    path = tokenfile.new_path(spark)
    tokenfile.write(long_docs.where("doc_id <> 1"), path, BPE)
    got = {r["doc_id"]: r for r in tokenfile.read(spark, path).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    for r in long_docs.where("doc_id <> 1").collect():
        assert got[r["doc_id"]]["ids"] == [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
    out = pieces.encode(long_docs.where("doc_id <> 1"), PIECES, ["doc_id"])
    assert out.agg(F.count_if("exact")).first()[0] == 4


def test_odd_rows_through_every_stage(spark, odd_docs):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    columns = set(plain.columns)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, plain, SF)
        rows = out.collect()
        assert len(rows) <= plain.count()
        if name != "tokens":
            assert set(out.columns) == columns
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in plain.collect()}
        else:
            assert len(rows) == plain.count()
