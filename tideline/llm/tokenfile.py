"""Token ids in Simple-8b files.

A 64-bit word holds a 4-bit selector and 60 bits: selector s packs COUNT[s] ids of WIDTH[s] bits, lowest first. Selector
0 is an escape: the next word is one id as it is, so any id below 2**64 can be kept. Words come in blocks; a block's
header has the documents' ids and where each of them ends, so a reader finds any document and decodes a block with
a handful of array operations (all words of one selector at a time, placed by running counts).

A file is a Parquet table, so that every store Spark writes to will do; each row is one block's bytes.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import rows_in, scratch_root

MAGIC = b"S8B1"
#: Ids per word and bits per id, by selector from 1.
WIDTH = (64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNT = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of an array of unsigned ids: from each place the selector that takes most ids."""
    ids, n = np.asarray(ids, dtype=np.uint64), len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    # Bits of each id (60 and more as an escape's 64), then the most bits in the next 2, 3, ... ids, from shorter spans.
    # Behind the end come zeros, which fit anywhere and which the count in the header cuts off.
    bits = np.concatenate([np.frexp(ids.astype(np.float64))[1].astype(np.uint8), np.zeros(max(COUNT), np.uint8)])
    widest, step, selector = {1: bits}, np.ones(n, np.uint8), np.zeros(n, np.uint8)
    for s in range(len(WIDTH) - 1, 0, -1):
        c = COUNT[s]
        if c not in widest:
            half = max(k for k in widest if k <= c)
            rest = max(k for k in widest if k <= c - half) if c > half else half
            wide = np.maximum(widest[half][: len(bits) - half], widest[rest][half : len(bits)][: len(bits) - half])
            covered = half + rest
            while covered < c:
                more = max(k for k in widest if k <= c - covered)
                wide = np.maximum(wide[: len(bits) - covered], widest[more][covered : len(bits)][: len(bits) - covered])
                covered += more
            widest[c] = np.concatenate([wide, np.zeros(len(bits) - len(wide), np.uint8)])
        fits = widest[c][:n] <= WIDTH[s]
        if c > 1 and not fits.any():
            break
        np.copyto(step, c, where=fits)
        np.copyto(selector, s, where=fits)
    at, hops, starts = 0, step.tolist(), []
    while at < n:
        starts.append(at)
        at += hops[at]
    starts = np.array(starts)
    used = selector[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(used == 0)[:-1]])
    words = np.zeros(len(starts) + int((used == 0).sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(used):
        at, to = starts[used == s], place[used == s]
        if s == 0:
            words[to + 1] = ids[at]
            continue
        shifts = np.arange(COUNT[s], dtype=np.uint64) * np.uint64(WIDTH[s])
        words[to] = np.bitwise_or.reduce(padded[at[:, None] + np.arange(COUNT[s])] << shifts, axis=1) | np.uint64(int(s) << 60)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of Simple-8b words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == 0):  # a literal's own top bits mean nothing
        if not raw[at]:
            raw[at + 1] = True
    counts = np.where(raw, 0, np.array(COUNT)[np.where(selector == 15, 0, selector)])
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector[~raw]):
        at = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[begin[at]] = words[at + 1]
            continue
        shifts = np.arange(COUNT[s], dtype=np.uint64) * np.uint64(WIDTH[s])
        out[begin[at][:, None] + np.arange(COUNT[s])] = (words[at][:, None] >> shifts) & np.uint64((1 << WIDTH[s]) - 1)
    return out[:n]


def block_bytes(keys: list[int | None], ids: list[bytes]) -> bytes:
    """One block of documents' ids (little-endian, 32 bits): counts, the documents' keys (and which are null), where each ends, the words."""
    ends = np.cumsum([len(x) // 4 for x in ids], dtype="<i8")
    words = pack(np.frombuffer(b"".join(ids), "<u4"))
    head = struct.pack("<4sIQQ", MAGIC, len(keys), int(ends[-1]), len(words))
    return b"".join([head, np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], "u1").tobytes(), ends.tobytes(), words.astype("<u8").tobytes()])


def read_block(block: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    magic, docs, n, n_words = struct.unpack_from("<4sIQQ", block)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block")
    at = 24
    keys = np.frombuffer(block, "<i8", docs, at)
    null = np.frombuffer(block, "u1", docs, at + 8 * docs)
    ends = np.frombuffer(block, "<i8", docs, at + 9 * docs)
    ids = unpack(np.frombuffer(block, "<u8", n_words, at + 17 * docs), n)
    return [None if gone else int(k) for k, gone in zip(keys, null, strict=True)], np.split(ids, ends[:-1])


#: The pre-tokenizer pattern for which words may be taken apart at white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_at_space(spec: dict) -> bool:
    """Whether a tokenizer file works word by word in the way that WordBpe relies on."""
    normal, before, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = [x.get("type") for x in normal.get("normalizers", [])]
    split, *rest = before.get("pretokenizers") or [{}]
    return (
        steps == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1].get("pattern") == {"Regex": r"\s+"} and normal["normalizers"][1].get("content") == " "
        and split.get("type") == "Split" and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and all(x["content"].startswith("<|") for x in spec.get("added_tokens", []))
    )


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One tokenizer, with what it remembers, for all tasks of a Python worker."""
    return WordBpe(path)


class Memory(dict):
    """What a function gives for texts that have been asked for."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        got = self[text] = self.make(text)
        return got

    def trim(self, most: int) -> None:
        """Forgets the later half beyond `most` texts: what came first is what comes often."""
        if len(self) > most:
            for text in list(itertools.islice(self, most // 2, None)):
                del self[text]


class WordBpe:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once while it is remembered, and so are words.

    Words are what stands between white space. Where the vocabulary file lower-cases, never lets a token span white space and
    pre-tokenises by the pattern below, words of texts within Latin-1 (without control characters) are split at white space
    here, and new ones into the pattern's pieces, which go through the library. Other texts go to the library by their space-separated parts, and with
    another vocabulary file every text goes to it whole. `remember` bounds memory.
    """

    LETTERS = "a-zªµºß-öø-ÿ"
    DIGITS = "0-9²³¹¼½¾"
    PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\x09-\x0d\x20\x85\xa0{LETTERS}{DIGITS}]+")
    PLAIN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), 0x85, *range(0xA0, 0x100)])
    SPACE = re.compile(r"[\x20\x09-\x0d]+")

    def __init__(self, path: str, remember: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.remember = Tokenizer.from_file(path), remember
        with open(path, encoding="utf-8") as f:
            self.by_word = _splits_at_space(json.load(f))
        self.model = self.library.model
        self.pieces = Memory(self._piece)
        of, split = self.pieces.__getitem__, self.PIECE.findall
        self.words = Memory(lambda word: b"".join(map(of, split(word))))
        self.parts = Memory(self._alone)

    def _alone(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece in lower case. Normalising and pre-tokenising change nothing in one of visible ASCII characters."""
        if piece.isascii():
            return np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()
        return self._alone(piece)

    def _plain(self, text: str | None) -> str | None:
        """A text within Latin-1, without control characters and special tokens, in lower case; None for others."""
        try:
            odd = not text or text.encode("latin-1").translate(None, self.PLAIN) or "<|" in text
        except UnicodeEncodeError:
            return None
        return None if odd else text.lower()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return [self._alone(t or "") for t in texts]
        for memory in (self.pieces, self.words, self.parts):
            memory.trim(self.remember)
        plain = [self._plain(t) for t in texts]
        out = [b"".join(self.parts[p] for p in self.SPACE.split(t or "") if p) if low is None else b"" for t, low in zip(texts, plain, strict=True)]
        at = [i for i, low in enumerate(plain) if low is not None]
        if at:
            # Words of all those texts at once, each distinct one looked up once.
            split = pc.utf8_split_whitespace(pa.array([plain[i] for i in at], pa.large_string()))
            words = split.flatten().dictionary_encode()
            made = list(map(self.words.__getitem__, words.dictionary.to_pylist()))
            code = words.indices.to_numpy()
            size = np.array([len(x) >> 2 for x in made], np.int64)
            begin = np.cumsum(size) - size
            ids, sizes = np.frombuffer(b"".join(made), "<u4"), size[code]
            ends = np.cumsum(sizes)
            raw = ids[np.repeat(begin[code] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
            cut = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()] * 4
            for i, x, y in zip(at, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                out[i] = raw[x:y]
        return out


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text", block_ids: int = 1 << 16) -> None:
    """Encodes every text, appends end_id, and writes blocks to `path` in ascending order of key (nulls first).

    Null and empty texts have the end id alone; an empty table writes no block; rows that share a key follow each other
    in any order. Rows are dealt by ranges of the key: `part` and `block` number them in
    that order, and `before` counts the ids before a block in its part.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, part, number = tokenizer(vocabulary), struct.pack("<I", end_id), TaskContext.get().partitionId(), 0
        keys, ids, held, before = [], [], 0, 0

        def block() -> pa.RecordBatch:
            made = block_bytes(keys, ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([made], pa.binary())], names=["part", "block", "before", "n_ids", "bytes"])

        for whole in batches:
            for batch in rows_in(iter([whole]), 4 << 20):
                for k, got in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1).to_pylist()), strict=True):
                    one = got + end
                    keys.append(k)
                    ids.append(one)
                    held += len(one) >> 2
                    if held >= block_ids:
                        yield block()
                        keys, ids, held, number, before = [], [], 0, number + 1, before + held
        if keys:
            yield block()

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k")
    ordered.mapInArrow(run, "part int, block long, before long, n_ids long, bytes binary").write.parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document of a written file: key, start (ids of all documents before it), n_tokens, ids_crc32 and the ids."""
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each file part
    part_begins, total = {}, 0
    for row in sizes:
        part_begins[row["part"]], total = total, total + row["n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, ids = read_block(block)
                n = np.array([len(x) for x in ids], np.int64)
                small = [x.astype("<u4") for x in ids]
                columns = [pa.array(keys, pa.int64()), pa.array(part_begins[part] + start + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in small], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in small], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["k", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return blocks.select("part", "before", "bytes").mapInArrow(run, "k long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids).withColumnRenamed("k", key)


def new_path(spark: SparkSession) -> str:
    import uuid

    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/simple8b-{uuid.uuid4().hex}"
