"""Sharding, token files, pieces, media: brute force and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import media, pieces, sharding, tokenfile
from tideline.llm.queries import op9_simple8b, op10_interleaved_media

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def least_capacity(sizes, shards):
    best = [0] + [10**18] * len(sizes)  # by exhaustion: best[i] for the first i groups and the runs so far
    for _ in range(shards):
        best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=9), st.integers(1, 5))
def test_cuts_are_minimax_and_contiguous(sizes, shards):
    run = sharding.cuts(np.array(sizes), shards)
    loads = [sum(s for s, r in zip(sizes, run, strict=True) if r == k) for k in range(shards)]
    assert (np.diff(run) >= 0).all() and max(loads) == least_capacity(sizes, shards) == sharding.smallest_capacity(np.array(sizes), shards)


def check_shards(docs, shards):
    rows = sharding.shard(docs, shards, digits=3).collect()
    source = docs.select("doc_id", "text").collect()
    assert len(rows) == len(source)
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in source)
    by_text = {}
    for r in rows:
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) <= 2 for s in by_text.values())  # null and the empty text share size and CRC but not group
    return rows


def test_shards_of_documents(spark, some_docs):
    rows = check_shards(some_docs, 8)
    loads = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(8)]
    assert max(loads) <= sum(loads) / 8 + max(r["size"] for r in rows)


def test_shards_odd_rows(odd_docs, no_docs):
    check_shards(odd_docs, 3)
    assert sharding.shard(no_docs, 3).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    words = tokenfile.pack(np.array(ids, np.uint64))
    assert tokenfile.unpack(words, len(ids)).tolist() == ids


def test_blocks_round_trip():
    keys, ids = [3, None, 9], [np.array([5, 2], "<u4"), np.array([2], "<u4"), np.arange(1000, dtype="<u4")]
    k, got = tokenfile.read_block(tokenfile.block_bytes(keys, [x.tobytes() for x in ids]))
    assert k == keys and all((a == b).all() for a, b in zip(got, ids, strict=True))
    with pytest.raises(ValueError):
        tokenfile.read_block(b"nope" + bytes(40))


def test_piecewise_ids_equal_the_librarys(some_docs):
    library, ours = Tokenizer.from_file(BPE), tokenfile.WordBpe(BPE, remember=500)
    texts = [r["text"] for r in some_docs.collect()] + ["", "don't 's x's", "a b ΣΑΣ İ", "<|endoftext|> 1½²", "\x85a\xa0b\x1c", "é é"]
    for t, got in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_another_vocabulary_goes_through_the_library_whole(tmp_path):
    import json

    with open(BPE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = None
    with open(tmp_path / "cased.json", "w", encoding="utf-8") as f:
        json.dump(spec, f)
    library, ours = Tokenizer.from_file(str(tmp_path / "cased.json")), tokenfile.WordBpe(str(tmp_path / "cased.json"))
    text = "Some WORDS, and É don't"
    assert not ours.by_word and tokenfile.WordBpe(BPE).by_word
    assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_file_of_documents(spark):
    library = Tokenizer.from_file(BPE)
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in op9_simple8b(spark, SF).collect()}
    start = 0
    for k, t in rows:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_file_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        path = tokenfile.new_path(spark)
        tokenfile.write(docs, path, BPE, block_ids=10)
        out = tokenfile.read(spark, path).collect()
        assert len(out) == docs.count() and all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in out)
        assert sorted(r["start"] for r in out) == np.cumsum([0, *(r["n_tokens"] for r in sorted(out, key=lambda r: r["start"]))])[:-1].tolist()


def test_pieces_equal_the_librarys(some_docs):
    library, ours = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Encoder(pieces.Vocabulary(PIECES), remember=100)
    texts = [r["text"] for r in some_docs.limit(60).collect()] + ["", " ", "     a  b", "a" * 3000, "漢字😀\n\t", "ab" * 700, "=" * 90]
    for t in texts:
        ids = np.frombuffer(ours.encode(t), "<i4")
        assert ids.tolist() == library.encode(t) and ours.decode(ids) == t


def test_window_stays_bounded_and_commits():
    ours = pieces.Encoder(pieces.Vocabulary(PIECES))
    ours.stream("abcdefgh" * 2000)
    assert ours.widest <= 4 * ours.v.longest


def test_unigram_paths_have_the_best_score():
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    draw = np.random.default_rng(4)
    for p in model.pieces:
        if p.type == 1:
            p.score = -5 - 20 * draw.random()
    raw = model.SerializeToString()
    library, ours = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Encoder(pieces.Vocabulary(raw))
    total = lambda ids: sum(model.pieces[i].score for i in ids)
    for t in ("The quick brown fox", "internationalisation of words", "straße und häuser " * 20):
        assert abs(total(np.frombuffer(ours.encode(t), "<i4").tolist()) - total(library.encode(t))) < 1e-3


def test_pieces_odd_rows(odd_docs, no_docs):
    clashing = odd_docs.withColumn("IDS", F.lit("clash")).withColumn("exact", F.lit(7))
    out = pieces.encode(clashing, PIECES, clashing.columns).collect()
    assert len(out) == odd_docs.count() and out[0].asDict().keys() == {*odd_docs.columns, "n_ids", "ids", "exact"} and all(r["exact"] and r["n_ids"] == len(r["ids"]) for r in out)
    assert pieces.encode(no_docs, PIECES, ["doc_id"]).count() == 0


def test_html_sequence():
    page = "<article><p>One &amp; two</p><script>no()</script><figure><img src=a.png alt=A><figcaption>The <b>caption</b></figcaption></figure>tail<img data-sha256=ff alt='B'></article>"
    assert media.sequence(page) == [
        {"pos": 0, "kind": "text", "text": "One & two", "ref": None, "caption": None},
        {"pos": 1, "kind": "media", "text": None, "ref": "a.png", "caption": "The caption"},
        {"pos": 2, "kind": "text", "text": "tail", "ref": None, "caption": None},
        {"pos": 3, "kind": "media", "text": None, "ref": "ff", "caption": "B"},
    ]
    assert media.sequence(None) == media.sequence("") == [] and media.sequence("<p>open <img src=x") is not None


def test_media_of_documents(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op10_interleaved_media(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        data = (rows[r["doc_id"]] or "").encode()
        whole = data + bytes(-len(data) % 64 if data else 64)
        stored = media.to_pgm(whole, len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(data), len(whole), len(stored))
        assert (r["payload_sha256"], r["media_sha256"], r["tail_crc32"]) == (hashlib.sha256(whole).hexdigest(), hashlib.sha256(stored).hexdigest(), zlib.crc32(whole[-64:]))
        assert r["feature"] == media.feature(whole) and r["pos"] == 1 and media.from_pgm(stored) == (whole, len(data))


def test_media_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        parts = media.parts_of(media.pages_of(docs), "doc_id").where(F.col("kind") == "media")
        assert media.resolve(parts, media.measure(media.store_of(docs))).where("payload_bytes % 64 = 0").count() == docs.count()
    pages = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x<img src=y>")], "page_id long, html string")
    assert media.parts_of(pages, "page_id").count() == 2
