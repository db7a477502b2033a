"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes through a text character by character. At each boundary it keeps the best way to get there and the piece
that does; only the last `longest piece` boundaries can still be built on. Whenever the backpointer paths of all those
have a boundary in common, the ids up to it are committed and what lies before is forgotten. (Unigram paths over a text
that repeats one character may never agree; then backpointers, and nothing else, are kept until they do.)

Two kinds of vocabulary, as the file says. Unigram: a path's score is the sum of its pieces' scores. BPE: merging leaves
at each boundary one last piece, namely the one that merging wouldn't join differently with the piece before it; so a
transition scores 0 if the two pieces are what merging makes of their characters, and minus infinity if not. Either way
ids equal the library's. Characters outside the vocabulary become byte pieces.

Where no piece of the vocabulary spans a boundary, such as the start of a word or between a letter and a sign, paths always
converge; runs between such boundaries that have been seen are remembered with their ids.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tideline.llm.common import rows_in

SPACE = "▁"
LETTER = r"[^\W\d_]"
UNIGRAM = 1


class Vocabulary:
    """Pieces, scores and kinds of a SentencePiece model file (or its bytes)."""

    def __init__(self, model: str | bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.proto = proto.ModelProto()
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        self.proto.ParseFromString(model)
        spec, norm = self.proto.trainer_spec, self.proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation are read")
        self.unigram, self.prefix = spec.model_type == UNIGRAM, norm.add_dummy_prefix
        pieces = self.proto.pieces
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type in (1, 4)}  # normal, user-defined
        self.score = [p.score for p in pieces]
        self.text = [SPACE.join(p.piece.split(SPACE)) for p in pieces]
        self.bytes: dict[int, int] = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == 2)
        of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [of_byte.get(i, b"" if p.type in (2, 3, 5) else p.piece.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)]
        #: Every beginning of a piece, with the piece's id where it is one and -1 where it isn't.
        self.tree = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # Boundaries that no piece spans, so that all paths meet there: around a line feed that is in no piece, and
        # between a letter and a sign that follows a letter in no piece.
        after_letter = {y for p in self.ids for x, y in zip(p, p[1:], strict=False) if re.match(LETTER, x)}
        self.signs = "".join(c for c in string.punctuation if c not in after_letter)
        self.line_feed = not any("\n" in p for p in self.ids)


class Encoder:
    """Ids of texts; runs between boundaries that no piece spans are encoded once while they are remembered."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 1_000_000) -> None:
        self.v, self.remember = vocabulary, remember
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.widest = 0  # most boundaries held at once
        feed = "\n" if vocabulary.line_feed else ""
        ends = re.escape(SPACE + feed + vocabulary.signs)
        self.chunk = re.compile(f"{SPACE}*{LETTER}+(?=[{ends}]|$)|{SPACE}*[^{SPACE}{feed}]+|{SPACE}+" + ("|\n+" if feed else ""))

    def merged(self, text: str) -> list[str]:
        """What BPE merging makes of a few characters: the best-scored merge first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (p := self.v.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.v.score[p], i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], after[i] = whole, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _joins(self, key: int, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are side by side (a < 0: after an unknown character or at a start); remembered under key."""
        want = [self.v.text[b]] if a < 0 else [self.v.text[a], self.v.text[b]]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        got = self.pairs[key] = self.merged("".join(want)) == want
        return got

    def stream(self, text: str) -> list[int]:
        """Ids of a run of characters, space marks included.

        Boundaries from `base` on are held: where the last piece starts (-1: not reached yet), that piece, the score. When a
        start is taken up its own boundary is final, as all pieces from before have been tried.
        """
        v, pairs, tree, out, base, n = self.v, self.pairs, self.v.tree, [], 0, len(text)
        unigram, scores, longest, get = v.unigram, v.score, v.longest, tree.get
        size = min(n, 3 * longest) + 1
        begin, last, score = [-1] * size, [-1] * size, [0.0] * size
        begin[0] = 0
        for start in range(n):
            if min(start + longest, n) - base >= size:
                begin, last, score, size = begin + [-1] * longest, last + [-1] * longest, score + [0.0] * longest, size + longest
            a, so_far, at = last[start - base], score[start - base], start - base
            for stop in range(start + 1, n + 1):
                piece = get(text[start:stop])
                if piece is None:
                    break
                at += 1
                if piece < 0:
                    continue
                if unigram:
                    total = so_far + scores[piece]
                    if begin[at] < 0 or total > score[at]:
                        begin[at], last[at], score[at] = start, piece, total
                elif begin[at] < 0:
                    key = a << 20 | piece
                    ok = pairs.get(key)
                    if ok or ok is None and self._joins(key, a, piece):
                        begin[at], last[at] = start, piece
            at = start + 1 - base
            if begin[at] < 0 or unigram:
                single = v.ids.get(text[start], -1)
                if begin[at] < 0 and not unigram:  # an unknown character; or a vocabulary in which merging leaves none of the pieces tried
                    begin[at], last[at] = start, single
                elif single < 0 and (begin[at] < 0 or so_far + v.worst > score[at]):
                    begin[at], last[at], score[at] = start, -1, so_far + v.worst
            if at > 2 * longest:
                self.widest = max(self.widest, at)
                fresh = self._commit(text, begin, last, base, start + 1, out) - base
                if fresh:
                    begin, last, score, base = begin[fresh:] + [-1] * fresh, last[fresh:] + [-1] * fresh, score[fresh:] + [0.0] * fresh, base + fresh
        self._emit(text, begin, last, base, n, out)
        return out

    @staticmethod
    def _path(begin: list[int], base: int, stop: int) -> list[int]:
        way = []
        while stop > base:
            way.append(stop)
            stop = begin[stop - base]
        return way

    def _commit(self, text: str, begin: list[int], last: list[int], base: int, stop: int, out: list[int]) -> int:
        """Commits up to the last boundary that the paths of all live boundaries share; returns the new base."""
        common: set[int] | None = None
        for live in range(max(stop - self.v.longest + 1, base), stop + 1):
            way = set(self._path(begin, base, live))
            common = way if common is None else common & way
            if not common:
                return base
        shared = max(common)
        self._emit(text, begin, last, base, shared, out)
        return shared

    def _emit(self, text: str, begin: list[int], last: list[int], base: int, stop: int, out: list[int]) -> None:
        for at in reversed(self._path(begin, base, stop)):
            piece = last[at - base]
            if piece >= 0:
                out.append(piece)
            elif self.v.bytes:
                out.extend(self.v.bytes[b] for b in text[begin[at - base] : at].encode("utf-8", "surrogatepass"))
            else:
                out.append(self.v.unknown)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text; none for a null or empty one."""
        if not text:
            return b""
        marked = (SPACE if self.v.prefix else "") + text.replace(" ", SPACE)
        if not self.v.by_word:
            return np.array(self.stream(marked), "<i4").tobytes()
        if len(self.words) > self.remember:  # what came first is what comes often
            self.words = dict(itertools.islice(self.words.items(), self.remember // 2))
        chunks, seen = self.chunk.findall(marked), self.words
        for chunk in set(chunks).difference(seen):
            seen[chunk] = np.array(self.stream(chunk), "<i4").tobytes()
        return b"".join(map(seen.__getitem__, chunks))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. A space mark in the text comes back as a space; the prefix that encoding adds is taken off."""
        raw = b"".join(map(self.v.raw.__getitem__, ids.tolist()))
        said = raw.decode("utf-8", "replace")
        return said[1:] if self.v.prefix and said.startswith(" ") else said


@functools.lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    """One encoder, with what it remembers, for all tasks of a Python worker."""
    return Encoder(Vocabulary(model))


def encode(docs: DataFrame, model: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of docs with n_ids, ids, and exact: decoding the ids gives the text back.

    Null and empty texts have no ids and are exact. Texts are read whole, however long; equal texts get equal ids; an
    empty table gives no rows. exact is false only for texts with the space mark itself (it decodes as a space) or lone surrogates.
    Columns of `keep` that are called n_ids, ids or exact (in any case) give way to these; columns not in it are not read.
    """
    keep = [c for c in keep if c.lower() not in ("n_ids", "ids", "exact")]
    schema = StructType([docs.schema[c] for c in keep] + StructType.fromDDL("n_ids int, ids array<int>, exact boolean").fields)
    list_type = to_arrow_type(schema["ids"].dataType)

    def run(batches):
        coder = encoder(model)
        for whole in batches:
            for batch in rows_in(iter([whole]), 4 << 20):
                texts = batch.column(len(keep)).to_pylist()
                made = [np.frombuffer(coder.encode(t), "<i4") for t in texts]
                exact = [coder.decode(m) == (t or "") for m, t in zip(made, texts, strict=True)]
                ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.diff(ends)), ids.cast(list_type), pa.array(exact, pa.bool_())], names=[*keep, "n_ids", "ids", "exact"])

    return docs.select(*keep, F.col(text).alias("_whole_text")).mapInArrow(run, schema)
