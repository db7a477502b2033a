"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit one linear classifier over hashed byte n-grams (1 to 3) says on
which side of the bit a text lies. Decoding adds up, over the bits, the logistic loss of the margin against each
language's codeword, weighted by how well the bit's classifier does; the least loss wins. A second language that comes
close makes the answer ambiguous.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import bounded, map_text, rows_in, sampled

UNDETERMINED = "und"
#: ASCII letters in lower case; all other ASCII is a space; bytes of other letters stay.
FOLD = bytes(ord(chr(i).lower()) if chr(i).isascii() and chr(i).isalpha() else i if i > 127 else 32 for i in range(256))
CHUNK = 1 << 20


def ngram_counts(text: str, bits: int) -> np.ndarray:
    """Counts of the hashed byte 1- to 3-grams of a whole text, however long (worked through in chunks)."""
    data = b" " + text.encode("utf-8", "surrogatepass").translate(FOLD) + b" "
    counts = np.zeros(1 << bits, dtype=np.int64)
    for at in range(0, len(data), CHUNK):
        one = np.frombuffer(data, dtype=np.uint8, offset=max(at - 2, 0), count=min(CHUNK, len(data) - at) + min(at, 2)).astype(np.uint32)
        fresh = min(at, 2)
        two = one[:-1] * np.uint32(256) + one[1:] + np.uint32(1 << 24)
        three = two[:-1] * np.uint32(256) + one[2:] + np.uint32(77)
        for grams, overlap in ((one, fresh), (two, max(fresh - 1, 0)), (three, 0)):
            hashed = (grams[overlap:] * np.uint32(2654435761)) >> np.uint32(32 - bits)
            counts += np.bincount(hashed, minlength=1 << bits)
    return counts


def features(text: str, bits: int) -> np.ndarray:
    root = np.sqrt(ngram_counts(text, bits).astype(np.float32))
    return root / max(float(np.linalg.norm(root)), 1e-9)


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """A row of +1/-1 bits for each of n languages: all distinct splits for up to 6, beyond that the best of many random draws."""
    if n < 2:
        return np.ones((n, 0), np.float32)
    if n <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.float32).T.reshape(n, -1)
    draw = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(64):
        code = draw.choice(np.array([1, -1], dtype=np.float32), size=(n, 10 * int(np.ceil(np.log2(n)))))
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if apart > far and all(abs(c.sum()) < n for c in code.T):
            best, far = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, mean 1
    bits: int
    close: float

    def predict(self, text: str | None) -> tuple[str, float, bool, str | None]:
        """Language, score (0 to 1), whether it is ambiguous, and the runner-up."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True, None
        margin = features(text, self.bits) @ self.weights + self.bias
        loss = (np.logaddexp(0, -self.code * margin) * self.trust).sum(axis=1)
        chance = np.exp(loss.min() - loss)
        chance /= chance.sum()
        order = np.lexsort((np.arange(len(loss)), loss))
        first, second = order[0], order[1] if len(order) > 1 else None
        score = min(float(chance[first]), 1.0)
        unsure = second is not None and chance[first] - chance[second] < self.close
        return self.languages[first], score, bool(unsure), None if second is None else self.languages[second]


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", most_rows: int = 4000, bits: int = 12, epochs: int = 12, close: float = 0.2, seed: int = 1) -> LanguageModel:
    """Learns from text and non-null language of the rows where `learn` holds.

    The sample is bounded: each of L languages gives about most_rows / L rows, picked by a seeded hash, equal rows once, and all
    together a quarter more than most_rows at most; one count of each language over all rows sets the shares. Features of the sample (2**bits half floats a row) go to the driver.
    No labelled rows: a model without languages, which answers `und` to everything.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    count = {r[lang]: r["count"] for r in known.groupBy(lang).count().collect()}
    languages = sorted(count)
    code = codewords(len(languages), seed)
    width = code.shape[1]
    if not languages or not width:
        return LanguageModel(languages, np.ones((len(languages), 0), np.float32), np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32), np.zeros(0), bits, close)
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col(lang) == name, min(1.0, most_rows / len(languages) / count[name])).otherwise(share)

    def run(batches):
        for whole in batches:
            for batch in rows_in(iter([whole])):
                made = [features(t, bits).astype(np.float16).tobytes() for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.binary())], names=["lang", "x"])

    picked = bounded(sampled(known, key, share, seed).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")), most_rows + most_rows // 4, seed)
    picked = picked.select("text", "lang").mapInArrow(run, "lang string, x binary").toArrow()
    order = sorted(range(picked.num_rows), key=lambda i: (picked["x"][i].as_py(), picked["lang"][i].as_py()))
    x = np.frombuffer(b"".join(picked["x"][i].as_py() for i in order), dtype=np.float16).reshape(len(order), 1 << bits)
    place = {name: i for i, name in enumerate(languages)}
    y = code[[place[picked["lang"][i].as_py()] for i in order]]
    weights, bias = np.zeros((1 << bits, width), np.float32), np.zeros(width, np.float32)
    moved, moved_bias = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in np.array_split(draw.permutation(len(x)), max(1, len(x) // 32)):
            part = x[at].astype(np.float32)
            pull = -y[at] / (1 + np.exp(np.clip(y[at] * (part @ weights + bias), -30, 30))) / max(len(at), 1)
            step, step_bias = part.T @ pull + 1e-6 * weights, pull.sum(axis=0)
            moved += step * step
            moved_bias += step_bias * step_bias
            weights -= 0.5 * step / np.sqrt(moved)
            bias -= 0.5 * step_bias / np.sqrt(moved_bias)
    right = np.mean([(np.sign(x[i : i + 512].astype(np.float32) @ weights + bias) == y[i : i + 512]).mean(axis=0) for i in range(0, max(len(x), 1), 512)], axis=0) if len(x) else np.full(width, 0.5)
    odds = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
    return LanguageModel(languages, code, weights, bias, odds / odds.mean(), bits, close)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, ambiguous and runner_up. A text that is null, empty or without letters is `und`, score 0,
    ambiguous. Texts are read whole; equal texts get equal answers; nothing but the text is looked at."""
    return map_text(docs, text, "lang_pred string, score double, ambiguous boolean, runner_up string", lambda texts: [model.predict(t) for t in texts])


def confident(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose text has a language: not `und`, and not ambiguous."""
    found = map_text(docs, text, "_lang string, _score double, _unsure boolean, _second string", lambda texts: [model.predict(t) for t in texts], keep=lambda r: r[0] != UNDETERMINED and not r[2])
    return found.select(*docs.columns)
