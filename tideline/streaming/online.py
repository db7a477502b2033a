"""Models that learn from streams.

Gram state is the exact, order-free form: (n, sums of products) adds up over batches and devices, and equals a fit on all
data. The recursive form forgets by a weight and depends on order; it is kept for each key in the stream's state store.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tideline.functions.linalg import spectrum
from tideline.operators import gram
from tideline.operators.collection import Collection, running_before
from tideline.operators.dynamics import Dmd, LinearSystem, Model
from tideline.operators.windows import shift_pairs


@dataclass
class Recursive:
    """Recursive least squares of x+ = A x with forgetting weight; ready after 2 d pairs.

    Kept as sums, G = sum of x x' and H = sum of y x' (from 1e-15 I and 1e-15 A0), of which A = H G^-1: the same A as the rank-one
    recursion on G^-1 from 1e15 I gives in exact arithmetic, without its cancellation.
    """

    d: int
    weight: float = 1.0
    g: np.ndarray | None = None
    h: np.ndarray | None = None
    seen: int = 0

    def __post_init__(self) -> None:
        if self.g is None:
            self.g = 1e-15 * np.eye(self.d)
            self.h = 1e-15 * np.random.default_rng(1).normal(size=(self.d, self.d))

    @property
    def ready(self) -> bool:
        return self.seen >= 2 * self.d

    @property
    def a(self) -> np.ndarray:
        return np.linalg.lstsq(self.g.T, self.h.T, rcond=None)[0].T

    def batch(self, x: np.ndarray, y: np.ndarray) -> Recursive:
        """Many pairs at once, each weighing `weight` less than the next."""
        w = self.weight ** np.arange(len(x), 0, -1)[:, None]
        return self.add(x.T @ (w * x), y.T @ (w * x), len(x))

    def add(self, g: np.ndarray, h: np.ndarray, n: int) -> Recursive:
        """n pairs by their weighted sums of products."""
        fade = self.weight**n
        self.g, self.h, self.seen = fade * self.g + g, fade * self.h + h, self.seen + n
        return self

    def update(self, x: np.ndarray, y: np.ndarray) -> None:
        self.batch(x[None], y[None])


@dataclass
class OnlineDmd(Model):
    """One recursive model over batches of series, in the order they come; within a batch pairs count in order of time, then id.

    A pair weighs `weight` less for each one after it, so a batch is one weighted sum of products."""

    weight: float = 1.0
    state: Recursive | None = None

    def partial_fit(self, tsc: Collection, delta: float = 1.0) -> OnlineDmd:
        self.features, self.delta = list(tsc.features), delta
        d, both = len(self.features), [*tsc.features, *(f"{f}_next" for f in tsc.features)]
        pairs, weigh = shift_pairs(tsc).select(tsc.id, tsc.time, *both), None
        if self.weight != 1.0:
            pairs = running_before(pairs.withColumn("_one", F.lit(1)), [tsc.time, tsc.id], "_one", "_before")
            pairs, weigh = pairs.crossJoin(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("_all")))).withColumn("_w", F.pow(F.lit(self.weight), F.col("_all") - F.col("_before"))), "_w"
        products, n = gram.matrix(pairs, self.features, both, weigh)
        self.state = self.state or Recursive(d, self.weight)
        self.state.add(products[:, :d], products[:, d:].T, n)
        if self.state.ready:
            self.system = LinearSystem(self.state.a, "flowmap", "spectral", delta)
        return self


@dataclass
class GramState:
    """(n, products) of samples with their successors; adds up exactly."""

    features: list[str]
    products: np.ndarray | None = None
    n: int = 0

    def added(self, tsc: Collection) -> GramState:
        both, n = gram.matrix(shift_pairs(tsc), self.features + [f"{f}_next" for f in self.features])
        return GramState(self.features, both if self.products is None else self.products + both, self.n + n)

    def add(self, tsc: Collection) -> GramState:
        more = self.added(tsc)
        self.products, self.n = more.products, more.n
        return self

    schema = "n long, products array<double>"

    def row(self) -> tuple:
        return int(self.n), self.products.ravel().tolist() if self.products is not None else None

    def restored(self, row) -> GramState:
        d = 2 * len(self.features)
        return GramState(self.features, np.array(row["products"]).reshape(d, d) if row["products"] is not None else None, row["n"])

    def model(self, delta: float = 1.0, **how) -> Dmd:
        d, made = len(self.features), Dmd(**how)
        made.features, made.delta = list(self.features), delta
        made.fit_gram(self.products[:d, :d] / self.n, self.products[:d, d:] / self.n, self.products[d:, d:] / self.n)
        return made


@dataclass
class Bases:
    """Low-rank state of pairs (x, y) of d features: orthonormal bases U of what went in and V of what came out, of at most `rank` columns, and
    the sums A = V'(sum of y x')U, G = U'(sum of x x')U and H = V'(sum of y y')V. States of different pairs merge, in any order; with no
    more directions in the data than `rank` nothing is lost, else those that carry least."""

    rank: int
    u: np.ndarray
    v: np.ndarray
    a: np.ndarray
    g: np.ndarray
    h: np.ndarray
    n: int = 0

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, rank: int, tol: float = 1e-12) -> Bases:
        """Of a block of pairs (rows)."""
        u, v = (np.linalg.svd(m.T, full_matrices=False)[:2] for m in (x, y))
        u, v = (m[0][:, m[1] > tol * m[1].max(initial=0)] for m in (u, v))
        xs, ys = x @ u, y @ v
        return cls(rank, u, v, ys.T @ xs, xs.T @ xs, ys.T @ ys, len(x)).cut()

    def cut(self) -> Bases:
        """Down to the rank."""
        for basis, square in (("u", "g"), ("v", "h")):
            if getattr(self, basis).shape[1] > self.rank:
                turn = np.linalg.eigh(getattr(self, square))[1][:, ::-1][:, : self.rank]
                setattr(self, basis, getattr(self, basis) @ turn)
                setattr(self, square, turn.T @ getattr(self, square) @ turn)
                self.a = self.a @ turn if basis == "u" else turn.T @ self.a
        return self

    def merge(self, other: Bases) -> Bases:
        """Both bases are spanned by one; sums are taken to it and added."""
        spans = []
        for mine, theirs in ((self.u, other.u), (self.v, other.v)):
            q, s, _ = np.linalg.svd(np.hstack([mine, theirs]), full_matrices=False)
            q = q[:, s > 1e-10]
            spans.append((q, q.T @ mine, q.T @ theirs))
        (u, u1, u2), (v, v1, v2) = spans
        a, g, h = v1 @ self.a @ u1.T + v2 @ other.a @ u2.T, u1 @ self.g @ u1.T + u2 @ other.g @ u2.T, v1 @ self.h @ v1.T + v2 @ other.h @ v2.T
        return Bases(self.rank, u, v, a, g, h, self.n + other.n).cut()

    def packed(self) -> dict:
        return {"n": int(self.n), "ku": int(self.u.shape[1]), "kv": int(self.v.shape[1]), "values": np.concatenate([m.ravel() for m in (self.u, self.v, self.a, self.g, self.h)]).tolist()}

    @classmethod
    def unpacked(cls, row, d: int, rank: int) -> Bases:
        ku, kv, values = row["ku"], row["kv"], np.array(row["values"], float)
        shapes = [(d, ku), (d, kv), (kv, ku), (ku, ku), (kv, kv)]
        cuts = np.cumsum([0, *(p * q for p, q in shapes)])
        return cls(rank, *(values[cuts[i] : cuts[i + 1]].reshape(s) for i, s in enumerate(shapes)), n=row["n"])

    def operator(self) -> np.ndarray:
        """The map in the coordinates of U."""
        return self.u.T @ self.v @ self.a @ np.linalg.pinv(self.g)

    def matrix(self) -> np.ndarray:
        """The map between features, d by d: for few features."""
        return self.v @ self.a @ np.linalg.pinv(self.g) @ self.u.T

    def modes(self) -> tuple[np.ndarray, np.ndarray]:
        values, right, _ = spectrum(self.operator())
        return values, self.u @ right


@dataclass
class StreamingDmd:
    """One pair at a time; `rank` bounds both bases (None: as many columns as features)."""

    rank: int | None = None
    bases: Bases | None = None

    def update(self, x: np.ndarray, y: np.ndarray) -> None:
        fresh = Bases.of(np.asarray(x, float)[None], np.asarray(y, float)[None], self.rank or len(x))
        self.bases = fresh if self.bases is None else self.bases.merge(fresh)

    def operator(self) -> np.ndarray:
        return self.bases.operator()

    def modes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.bases.modes()


BASES = "n long, ku int, kv int, values array<double>"


def bases_of(pairs: DataFrame, features: list[str], rank: int, suffix: str = "_next", rows: int = 4096, fan: int = 16) -> Bases | None:
    """State of all pairs: each task merges its own block by block, `fan` tasks merge theirs, the driver merges those. None without pairs."""
    d = len(features)

    def folded(states):
        total = None
        for s in states:
            total = s if total is None else total.merge(s)
        if total is not None:
            made = total.packed()
            yield pa.RecordBatch.from_arrays([pa.array([made["n"]]), pa.array([made["ku"]], pa.int32()), pa.array([made["kv"]], pa.int32()), pa.array([made["values"]], pa.list_(pa.float64()))], names=["n", "ku", "kv", "values"])

    def blocks(batches):
        for batch in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, 2 * d))
            for at in range(0, len(m), rows):
                yield Bases.of(m[at : at + rows, :d], m[at : at + rows, d:], rank)

    chosen = pairs.select(*(F.col(f).cast("double").alias(f"a{i}") for i, f in enumerate(features)), *(F.col(f"{f}{suffix}").cast("double").alias(f"b{i}") for i, f in enumerate(features)))
    parts = chosen.mapInArrow(lambda batches: folded(blocks(batches)), BASES).repartition(fan)
    parts = parts.mapInArrow(lambda batches: folded(Bases.unpacked(r, d, rank) for batch in batches for r in batch.to_pylist()), BASES)
    total = None
    for row in parts.collect():
        one = Bases.unpacked(row, d, rank)
        total = one if total is None else total.merge(one)
    return total


@dataclass
class BasesState:
    """Bases of all series that were added, for a BatchSink."""

    features: list[str]
    rank: int
    bases: Bases | None = None

    def added(self, tsc: Collection) -> BasesState:
        fresh = bases_of(shift_pairs(tsc), self.features, self.rank)
        return BasesState(self.features, self.rank, fresh if self.bases is None else self.bases if fresh is None else self.bases.merge(fresh))

    schema = BASES

    def row(self) -> tuple:
        made = self.bases.packed() if self.bases is not None else {"n": 0, "ku": 0, "kv": 0, "values": []}
        return tuple(made.values())

    def restored(self, row) -> BasesState:
        return BasesState(self.features, self.rank, Bases.unpacked(row, len(self.features), self.rank) if row["n"] else None)


def stateful(features: list[str], weight: float, time: str) -> StatefulProcessor:
    """Per key: a recursive model and the last sample. Emits the model after each batch of a key."""
    d = len(features)

    class Keyed(StatefulProcessor):
        def init(self, handle) -> None:
            self.value = handle.getValueState("model", "g array<double>, h array<double>, last array<double>, seen long")

        def handleInputRows(self, key, rows, timers):
            frame = pd.concat(list(rows)).sort_values(time)
            model, last = Recursive(d, weight), None
            if self.value.exists():
                g, h, last, seen = self.value.get()
                model = Recursive(d, weight, np.array(g).reshape(d, d), np.array(h).reshape(d, d), seen)
                last = np.array(last)
            for x in frame[features].to_numpy(float):
                if last is not None:
                    model.update(last, x)
                last = x
            self.value.update((model.g.ravel().tolist(), model.h.ravel().tolist(), last.tolist(), model.seen))
            yield pd.DataFrame({"id": [key[0]], "seen": [model.seen], "ready": [model.ready], "a": [model.a.ravel().tolist()]})

        def close(self) -> None:
            pass

    return Keyed()


def online_by_key(stream: DataFrame, id: str, time: str, features: list[str], weight: float = 1.0) -> DataFrame:
    """A streaming frame of (id, seen, ready, a): each key's own model. Rows of a key are ordered by time within a micro-batch."""
    return stream.select(F.col(id).alias("id"), time, *features).groupBy("id").transformWithStateInPandas(
        statefulProcessor=stateful(features, weight, time), outputStructType="id long, seen long, ready boolean, a array<double>", outputMode="Update", timeMode="None"
    )


@dataclass
class BatchSink:
    """For foreachBatch: adds each micro-batch of whole series to a state (sums of products, or low-rank bases with a rank). A batch number
    that has been added is skipped, so replays don't count twice. path: a folder that outlives the driver (beside the stream's
    checkpoint); each batch's number and the state so far are written there before they count, so a batch whose write failed is added
    when it comes again, and a new sink goes on from the last. Without one a restart begins anew."""

    features: list[str]
    id: str = "id"
    time: str = "time"
    path: str | None = None
    rank: int | None = None
    state: GramState | BasesState = field(init=False)
    last: int = -1

    def __post_init__(self) -> None:
        self.state = GramState(self.features) if self.rank is None else BasesState(self.features, self.rank)
        self.resumed = self.path is None

    def resume(self, spark: SparkSession) -> BatchSink:
        """Takes up the last state that was written, if there is one."""
        self.resumed = True
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [x.getPath() for x in files.listStatus(folder)] if files.exists(folder) else []
        whole = [int(p.getName()) for p in done if p.getName().isdigit() and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        if whole:
            self.last = max(whole)
            self.state = self.state.restored(spark.read.parquet(f"{self.path}/{self.last}").first())
        return self

    def __call__(self, batch: DataFrame, number: int) -> None:
        if not self.resumed:
            self.resume(batch.sparkSession)
        if number > self.last:
            fresh = self.state.added(Collection.of(batch, self.id, self.time, self.features))
            if self.path is not None:
                batch.sparkSession.createDataFrame([fresh.row()], fresh.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{number}")
            self.state, self.last = fresh, number
