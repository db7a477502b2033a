"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A word gives two tokens: itself, and its shape (runs of capitals, small letters and digits become X, x and 9, runs of a
sign one sign). Features are hashed 1- to 3-grams of words, hashed 1- to 3-grams of shapes, and whether a word bigram repeats;
their values are shares of the text, so that long and short texts are alike. A text's score is a sparse dot product: weights
taken at its features.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import bounded, forget, map_text, materialize, rows_in, sampled

RUNS = re.compile(r"(.)\1+", re.S)
SPAN = 1 << 18  # words of a text worked on at a time
#: Longer words are hashed each time, not remembered.
LONG = 256


def shape(word: str) -> str:
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return RUNS.sub(r"\1", kinds)


@dataclass
class Featurizer:
    bits: int = 18
    seen: dict[str, int] = field(default_factory=dict)

    def codes(self, words: list[str]) -> np.ndarray:
        """For each word the hash of the word (low half) and of its shape (high half)."""
        seen = self.seen
        if len(seen) > 300_000:
            seen.clear()
        out = [seen.get(w) for w in words]
        if None in out:
            for i, code in enumerate(out):
                if code is None:
                    w = words[i]
                    raw = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    out[i] = raw | zlib.crc32(b"s" + shape(w).encode("utf-8", "surrogatepass")) << 32
                    if len(w) <= LONG:
                        seen[w] = out[i]
        return np.array(out, dtype=np.uint64)

    def spans(self, text: str):
        """Arrays of feature numbers, one for each kind of n-gram, for spans of the text that overlap by two words."""
        words = text.split()
        earlier = np.zeros(0, np.uint64)  # word bigrams of the spans before
        top = np.uint64(64 - self.bits)
        for at in range(0, len(words), SPAN):
            back = min(at, 2)
            code = self.codes(words[at - back : at + SPAN])
            one = code >> np.uint64(32)
            two = one[:-1] * np.uint64(1000003) + one[1:]
            three = two[:-1] * np.uint64(1000003) + one[2:]
            word = code & np.uint64(0xFFFFFFFF)
            words2 = word[:-1] * np.uint64(1000003) + word[1:]
            words3 = words2[:-1] * np.uint64(1000003) + word[2:]
            pair = (code[:-1] * np.uint64(1000003) + code[1:])[max(back - 1, 0) :]
            again = np.ones(len(pair), np.uint64)  # word bigrams that the text has had before
            kinds_of_pair, first = np.unique(pair, return_index=True)
            again[first] = np.isin(kinds_of_pair, earlier) if len(earlier) else 0
            if at + SPAN < len(words):
                earlier = np.union1d(earlier, kinds_of_pair)
            kinds = ((word[back:], 1), (one[back:], 2), (two[max(back - 1, 0) :], 3), (three, 4), (again, 5), (words2[max(back - 1, 0) :], 6), (words3, 7))
            yield [((k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03 * n & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)) >> top for k, n in kinds]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values of a whole text."""
        found, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for kinds in self.spans(text or ""):
            number, count = np.unique(np.concatenate(kinds), return_counts=True)
            found, times = np.concatenate([found, number]), np.concatenate([times, count])
        number, place = np.unique(found, return_inverse=True)
        values = np.bincount(place, weights=times, minlength=len(number))
        return number.astype(np.int64), (values / max(values.sum(), 1)).astype(np.float32)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    scale: float
    bits: int

    def scorer(self):
        make, weights = Featurizer(self.bits), self.weights

        def score(text: str | None) -> float:
            total, n = 0.0, 0
            for kinds in make.spans(text or ""):
                for at in kinds:
                    total, n = total + float(weights[at].sum(dtype=np.float64)), n + len(at)
            z = self.bias + self.scale * total / max(n, 1)
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", label: str = "quality", key: str = "doc_id", most_rows: int = 4000, bits: int = 18, epochs: int = 4, seed: int = 7) -> QualityModel:
    """Learns label 0 or 1 from the texts of rows where `learn` (over the key) holds.

    Bounded sample: about most_rows labelled rows (a quarter more at most), picked by a seeded hash of the key on both sides of the join,
    so that neither side is shuffled whole. Rows with a null key or label don't count, equal rows count once; of a key's several
    labels all count. With no labelled rows the model says 0.5; with one class, near that class's share.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label)
    n = marked.count()
    share = F.lit(min(1.0, most_rows / max(n, 1)))
    some = sampled(docs.where(learn), key, share, seed).select(key, text)
    pairs = some.join(sampled(marked, key, share, seed), key).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    pairs = bounded(pairs, most_rows + most_rows // 4, seed).select("t", "y")

    def run(batches):
        make = Featurizer(bits)
        for whole in batches:
            for batch in rows_in(iter([whole])):
                made = [make.vector(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["y", "at", "x"])

    rows = materialize(pairs.mapInArrow(run, "y int, at binary, x binary"), "features")
    n, ones = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    size, scale, prior = 1 << bits, 100.0, float(np.log((ones + 1) / (n - ones + 1)))
    draw = np.random.default_rng(seed)
    turns = np.concatenate([draw.permutation(n) for _ in range(epochs)]) if n else np.zeros(0, np.int64)
    turns = spark.createDataFrame(pa.table({"i": turns.astype(np.int64), "turn": np.arange(len(turns))}))

    def begun() -> Ftrl:
        leader = Ftrl(size + 1)
        leader.z[-1] = -prior * (leader.beta / leader.alpha + leader.l2)  # the bias starts at the class shares
        return leader

    def learn_all(batches):
        leader = begun()
        for batch in batches:
            for at, x, y in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                at, x = np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float32)
                leader.learn(np.append(at, size), np.append(x * scale, 1.0), y.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([leader.weights().tobytes()])], names=["w"])

    # One sequence of updates: a single task reads the bounded sample once for each epoch, row by row; only weights come to the driver.
    numbered = rows.withColumn("i", F.row_number().over(Window.orderBy("at", "x", "y")) - 1)
    turned = numbered.join(turns, "i").repartition(1).sortWithinPartitions("turn").select("at", "x", "y")
    got = turned.mapInArrow(learn_all, "w binary").first()
    weights = np.frombuffer(got["w"], np.float64) if got is not None else begun().weights()
    forget(rows)
    return QualityModel(weights[:-1].astype(np.float32), float(weights[-1]), scale, bits)


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on). Null and empty texts have no words and
    get the bias alone; texts are read whole; equal texts get equal scores; only the text is looked at."""
    return map_text(docs, text, "score double, predicted int", _maker(model))


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of docs, unchanged, that are predicted 1."""
    return map_text(docs, text, "_score double, _predicted int", _maker(model), keep=lambda r: r[1] == 1).select(*docs.columns)


def _maker(model: QualityModel):
    state: dict = {}

    def make(texts):
        if "score" not in state:
            state["score"] = model.scorer()
        return [(s, int(s >= 0.5)) for s in map(state["score"], texts)]

    return make
