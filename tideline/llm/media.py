"""Interleaved document sequences with media.

HTML is parsed into an ordered sequence of parts: text, or a reference to a media object by the SHA-256 of its stored
form, with its caption. Stored forms are kept once for each digest; references find theirs by a join on the digest.
Positions and captions stay with their part. The stored form here is a binary PGM image: 8-bit samples, 64 to a row.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tideline.llm.common import rows_in

WIDTH = 64
HEADER = re.compile(rb"P5\n# bytes (\d+)\n(\d+) (\d+)\n255\n")
SKIPPED = {"script", "style", "template", "noscript"}
BLOCKS = set("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title".split())
PART = "pos int, kind string, text string, ref string, caption string"


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text with zero bytes up to a positive multiple of 64, and its length without them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH if data else WIDTH), len(data)


def to_pgm(data: bytes, n: int) -> bytes:
    """A binary PGM image of the payload; a comment in its header has the length without the zero bytes."""
    return b"P5\n# bytes %d\n%d %d\n255\n" % (n, WIDTH, len(data) // WIDTH) + data


def from_pgm(stored: bytes) -> tuple[bytes, int]:
    head = HEADER.match(stored)
    if not head or len(stored) - head.end() != int(head[2]) * int(head[3]):
        raise ValueError("not a PGM image")
    return stored[head.end() :], int(head[1])


def feature(data: bytes) -> str:
    """Mean, deviation and mean row difference of the samples, and the shares of 8 bands of values, as fixed-point text."""
    x = np.frombuffer(data, np.uint8)
    n, total, squares = len(x), int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    rows = x.reshape(-1, WIDTH).astype(np.int64)
    steps = int(np.abs(np.diff(rows, axis=1)).sum())
    bands = np.bincount(x >> 5, minlength=8) * 1000 // n
    return f"m{total * 1000 // n}:v{(squares * n - total * total) * 1000 // (n * n)}:d{steps * 1000 // (len(rows) * (WIDTH - 1))}:b" + ",".join(map(str, bands))


class _Tokens(HTMLParser):
    """What a page says, in order: (kind, ..) with the kinds text, block, media, figure, /figure, caption and /caption. What a closed element
    of SKIPPED holds is dropped; an element that is never closed hides nothing, but for the code in a script or style."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[tuple] = []
        self.hidden: list[tuple[str, int]] = []  # open elements of SKIPPED and where they began

    def handle_starttag(self, tag, attrs):
        got = dict(attrs)
        if tag in SKIPPED:
            self.hidden.append((tag, len(self.tokens)))
        elif tag == "figure":
            self.tokens.append(("figure",))
        elif tag == "figcaption":
            self.tokens.append(("caption",))
        elif tag in ("img", "video", "audio", "source") and (got.get("data-sha256") or got.get("src")):
            self.tokens.append(("media", got.get("data-sha256") or got["src"], got.get("alt")))
        elif tag in BLOCKS:
            self.tokens.append(("block",))

    def handle_startendtag(self, tag, attrs):
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            for k in reversed(range(len(self.hidden))):
                if self.hidden[k][0] == tag:
                    del self.tokens[self.hidden[k][1] :]
                    del self.hidden[k:]
                    break
        elif tag in ("figure", "figcaption"):
            self.tokens.append(("/figure",) if tag == "figure" else ("/caption",))
        elif tag in BLOCKS:
            self.tokens.append(("block",))

    def handle_data(self, data):
        if not (self.hidden and self.hidden[-1][0] in ("script", "style")):
            self.tokens.append(("text", data))


def _caption_end(tokens: list[tuple], at: int) -> int:
    """Where the caption that begins before `at` ends: at its end tag, or, if it is never closed, at the next token that isn't text."""
    depth = 0
    for k in range(at, len(tokens)):
        kind = tokens[k][0]
        if depth == 0 and kind == "/caption":
            return k
        if depth == 0 and kind in ("/figure", "caption"):
            break
        depth += (kind == "figure") - (kind == "/figure")
    return next((k for k in range(at, len(tokens)) if tokens[k][0] != "text"), len(tokens))


class _Sequence:
    """Parts of a page from its tokens."""

    def __init__(self, tokens: list[tuple]) -> None:
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.figures: list[dict] = []
        at = 0
        while at < len(tokens):
            kind = tokens[at][0]
            if kind == "caption":
                self.flush()
                end = _caption_end(tokens, at + 1)
                said = [t[1] for t in tokens[at + 1 : end] if t[0] == "text"]
                if self.figures:
                    self.figures[-1]["caption"] = "".join(said).strip()
                else:
                    self.text += said
                    self.flush()
                for token in tokens[at + 1 : end]:
                    if token[0] == "media":
                        self.add_media(token)
                at = end
                continue
            if kind == "text":
                self.text.append(tokens[at][1])
            elif kind == "media":
                self.add_media(tokens[at])
            else:
                self.flush()
                if kind == "figure":
                    self.figures.append({"media": [], "caption": None})
                elif kind == "/figure" and self.figures:
                    self.close_figure()
            at += 1
        self.flush()
        while self.figures:
            self.close_figure()

    def flush(self) -> None:
        said, self.text = "".join(self.text), []
        if said.strip():
            self.parts.append({"kind": "text", "text": said, "ref": None, "caption": None})

    def add_media(self, token: tuple) -> None:
        self.flush()
        if self.figures:
            self.figures[-1]["media"].append(len(self.parts))
        self.parts.append({"kind": "media", "text": None, "ref": token[1], "caption": token[2]})

    def close_figure(self) -> None:
        """A caption goes to the media that no inner figure's caption went to."""
        figure = self.figures.pop()
        if figure["caption"] is not None:
            for at in figure["media"]:
                self.parts[at]["caption"] = figure["caption"]
        elif self.figures:
            self.figures[-1]["media"] += figure["media"]


def sequence(page: str | None) -> list[dict]:
    """The parts of a page in their order, numbered from 0. Null and empty pages have none; broken HTML gives what can be read.

    A figure's caption (the last, if it has several) goes to each media reference in it, and in figures inside it that have none; without
    one the alt text is the caption. A caption that is never closed ends at the next tag that isn't inline; one outside a figure is text.
    What an unclosed noscript or template hides is read."""
    reader = _Tokens()
    if page:
        reader.feed(page)
        reader.close()
    return [{"pos": i} | part for i, part in enumerate(_Sequence(reader.tokens).parts)]


def parts_of(pages: DataFrame, key: str, page: str = "html") -> DataFrame:
    """A row for each part of each page: key, pos, kind, text, ref, caption."""
    schema = StructType([pages.schema[key]] + StructType.fromDDL(PART).fields)
    arrow = to_arrow_schema(StructType.fromDDL(PART))

    def run(batches):
        for whole in batches:
            for batch in rows_in(iter([whole])):
                made = [sequence(p) for p in batch.column(1).to_pylist()]
                keys = batch.column(0).take(pa.array([i for i, parts in enumerate(made) for _ in parts], pa.int64()))
                table = pa.Table.from_pylist([p for parts in made for p in parts], schema=arrow).combine_chunks()
                for out in table.to_batches() or []:
                    yield pa.RecordBatch.from_arrays([keys, *out.columns], names=[key, *arrow.names])

    return pages.select(key, page).mapInArrow(run, schema)


def resolve(parts: DataFrame, store: DataFrame) -> DataFrame:
    """Parts with what the store (digest, ...) holds under their reference; null where there is none. The store has a digest once."""
    return parts.join(store, parts["ref"] == store["digest"], "left").drop("digest")


def pages_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """An HTML page for each document: its text, and a figure that refers to the text's image by digest. Columns key, html."""
    schema = StructType([docs.schema[key], *StructType.fromDDL("html string").fields])

    def run(batches):
        for whole in batches:
            for batch in rows_in(iter([whole])):
                made = []
                for said in batch.column(1).to_pylist():
                    ref = hashlib.sha256(to_pgm(*payload(said))).hexdigest()
                    made.append(f'<article><p>{html.escape(said or "", quote=False)}</p><figure><img data-sha256="{ref}" alt="image"><figcaption>Image {ref[:12]}</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "html"])

    return docs.select(key, text).mapInArrow(run, schema)


def store_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every text's payload as a PGM image: digest, stored. Equal texts have one image in each task's part of the table at most."""

    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for batch in rows_in(iter([whole])):
                digests, images = [], []
                for said in batch.column(0).to_pylist():
                    image = to_pgm(*payload(said))
                    digest = hashlib.sha256(image)
                    if digest.digest() not in seen:
                        seen.add(digest.digest())
                        digests.append(digest.hexdigest())
                        images.append(image)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["digest", "stored"])

    return docs.select(text).mapInArrow(run, "digest string, stored binary")


def measure(stored: DataFrame) -> DataFrame:
    """Per stored digest, once, what its image's bytes, read back, give: the payload's and the stored form's sizes and digests, and the feature."""
    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for whole in batches:
            for batch in rows_in(iter([whole])):
                rows = []
                for digest, image in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                    data, n = from_pgm(image)
                    rows.append((digest, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(data)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(8)], names=arrow.names)

    return stored.select("digest", "stored").mapInArrow(run, schema).dropDuplicates(["digest"])
