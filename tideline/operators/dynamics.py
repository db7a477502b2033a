"""Linear dynamical systems and the models that learn them (dynamic mode decomposition and its relatives).

Learning is one pass over the data (a Gram matrix) and a small factorisation on the driver; prediction precomputes one
small matrix for each time and maps over the initial states. Order of eigenvalues: by real, then imaginary part, descending.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tideline.functions.linalg import expm, least_squares, logm, matrix_power, runge_kutta, spectrum
from tideline.operators import gram, metrics
from tideline.operators.checks import Checked
from tideline.operators.collection import Collection, CollectionError, tasks
from tideline.operators.windows import finite_difference, shift_pairs


@dataclass
class LinearSystem:
    """x' = A x + B u (differential) or x+ = A x + B u (flowmap); affine: B_k x u_k for each control.

    mode spectral evolves eigenvalues, matrix the matrix itself.
    """

    matrix: np.ndarray
    kind: str = "flowmap"
    mode: str = "matrix"
    delta: float = 1.0
    control: np.ndarray | None = None  # (states, controls), or (controls, states, states) if affine
    affine: bool = False
    parts: tuple | None = None  # eigenvalues, right, left

    def __post_init__(self) -> None:
        if self.kind not in ("flowmap", "differential") or self.mode not in ("matrix", "spectral"):
            raise CollectionError("kind is flowmap or differential, mode matrix or spectral")
        if self.mode == "spectral" and self.parts is None:
            self.parts = spectrum(self.matrix)

    def propagator(self, t: float) -> np.ndarray:
        """The matrix that takes a state to time t without control."""
        if self.mode == "spectral":
            values, right, left = self.parts
            power = np.exp(values * t) if self.kind == "differential" else values.astype(complex) ** (t / self.delta)
            return ((right * power) @ left).real
        return expm(self.matrix * t).real if self.kind == "differential" else matrix_power(self.matrix, t / self.delta).real

    def spectral_states(self, states: np.ndarray) -> np.ndarray:
        """Coordinates of states (rows) in the eigenvectors."""
        return states @ self.parts[2].T

    def evolve(self, state: np.ndarray, times: np.ndarray, controls: np.ndarray | None = None) -> np.ndarray:
        """States at `times` from `state` at the first of them; controls: one for each interval, held over it."""
        times = np.asarray(times, float)
        if self.control is None:
            return np.array([self.propagator(t - times[0]) @ state for t in times])
        steps = np.diff(times)
        if controls is None or len(controls) < len(steps):
            raise CollectionError("one control is needed for each interval")
        if self.kind == "differential":
            out = [np.asarray(state, float)]
            for t0, t1, u in zip(times[:-1], times[1:], controls, strict=False):
                drift = self.matrix + np.tensordot(u, self.control, 1) if self.affine else self.matrix
                push = 0.0 if self.affine else self.control @ u
                out.append(runge_kutta(lambda _, x, a=drift, b=push: a @ x + b, out[-1], np.array([t0, t1]))[-1])
            return np.array(out)
        if np.abs(steps - self.delta).max(initial=0) > 1e-9 * max(1.0, self.delta):
            raise CollectionError("a controlled flowmap moves in its own time step only")
        return self.evolve_all(np.asarray(state, float)[None], times, np.asarray(controls, float)[None, : len(steps)])[0]

    def evolve_all(self, states: np.ndarray, times: np.ndarray, controls: np.ndarray) -> np.ndarray:
        """Of many series (states: a row each; controls: series, intervals, inputs), as series, times, states."""
        if self.kind == "differential" or np.abs(np.diff(times) - self.delta).max(initial=0) > 1e-9 * max(1.0, self.delta):
            return np.array([self.evolve(x, times, u) for x, u in zip(states, controls, strict=True)]).reshape(len(states), len(times), -1)
        out, step = [states], self.matrix
        if self.mode == "spectral":  # of a model of few modes: what they hold of the state, and their own map
            values, right, left = self.parts
            out, step = [(states @ left.T @ right.T).real], ((right * values) @ left).real
        for k in range(len(times) - 1):
            u = controls[:, k]
            push = np.einsum("nm,mij,nj->ni", u, self.control, out[-1]) if self.affine else u @ self.control.T
            out.append(out[-1] @ step.T + push)
        return np.stack(out, axis=1)


def predict_frame(system: LinearSystem, initial: Collection, times: Sequence[float], control: Collection | None = None, output: np.ndarray | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """States of every series at `times`, counted from its own initial time.

    Without control: one matrix for each time, sent to tasks as an array and multiplied in Arrow batches, so the plan's size doesn't
    follow the number of times. With control: each series' controls, in order of time, meet its initial state. output: a matrix that maps
    states to what is returned.
    """
    names = list(names or initial.features)
    out = np.eye(len(initial.features)) if output is None else output
    if not np.isfinite(np.asarray(times, float)).all():
        raise CollectionError("times are finite")
    if control is None:
        return projected(initial, {None: np.array([out @ system.propagator(float(t)) for t in times])}, times, names)
    return controlled(system, initial, np.asarray(times, float), control, out, names)


def controlled(system: LinearSystem, initial: Collection, times: np.ndarray, control: Collection, output: np.ndarray, names: Sequence[str]) -> DataFrame:
    """Each series' controls, in order of time, are gathered beside its initial state; states then move on in Arrow batches, a linear flowmap
    with all series of a batch at once. Too few controls, or none, are an error."""
    i, t, d, m = initial.id, initial.time, len(initial.features), len(control.features)
    given = control.df.groupBy(F.col(control.id).alias("_of")).agg(F.array_sort(F.collect_list(F.struct(F.col(control.time).alias("t"), *(F.col(u).alias(f"u{k}") for k, u in enumerate(control.features))))).alias("_u"))
    chosen = initial.df.select(F.col(i).cast("long").alias(i), F.col(t).cast("double").alias(t), F.array(*(F.col(f).cast("double") for f in initial.features)).alias("_x"))
    rows = chosen.join(given, F.col(i) == F.col("_of"), "left").select(i, t, "_x", *(F.col(f"_u.u{k}").alias(f"_u{k}") for k in range(m)))
    steps = len(times) - 1
    schema = StructType([StructField(i, LongType()), StructField(t, DoubleType()), *(StructField(n, DoubleType()) for n in names)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            held = [pc.list_value_length(batch.column(3)).fill_null(0).to_numpy()] if m else [np.zeros(len(x), int)]
            if (held[0] < steps).any():
                raise CollectionError("one control is needed for each interval")
            begin = [batch.column(3 + k).offsets.to_numpy()[:-1] for k in range(m)]
            values = [batch.column(3 + k).values.to_numpy(zero_copy_only=False) for k in range(m)]
            u = np.stack([v[b[:, None] + np.arange(steps)] for v, b in zip(values, begin, strict=True)], axis=2) if steps else np.zeros((len(x), 0, m))
            made = system.evolve_all(x, times, u) @ output.T
            when = batch.column(1).to_numpy()[:, None] + times
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), len(times)))), pa.array(when.ravel()), *(pa.array(made[:, :, k].ravel()) for k in range(len(names)))], names=schema.names)

    return rows.mapInArrow(run, schema)


def projected(initial: Collection, matrices: dict, times: Sequence[float], names: Sequence[str], which: str | None = None, until: str | None = None) -> DataFrame:
    """States times matrices of shape (times, names, features), one set for each value of the column `which` (None: one for all rows); only
    the first `until` (a column) times of a row. A row without a value has none later."""
    times, d = np.asarray(times, float), len(initial.features)
    extra = [F.lit(None).cast("int") if which is None else F.col(which).cast("int"), F.lit(len(times)).cast("int") if until is None else F.least(F.col(until).cast("int"), F.lit(len(times)))]
    chosen = initial.df.select(initial.id, F.col(initial.time).cast("double"), *(F.col(f).cast("double") for f in initial.features), *(c.alias(n) for c, n in zip(extra, ("_which", "_until"), strict=True)))
    schema = StructType([chosen.schema[initial.id], StructField(initial.time, DoubleType()), *(StructField(n, DoubleType()) for n in names)])

    def run(batches):
        for batch in batches:
            of = np.array([-1 if v is None else v for v in batch.column(d + 2).to_pylist()], int)
            n = batch.column(d + 3).to_numpy()
            empty = np.array([batch.column(k + 2).is_null().to_numpy(zero_copy_only=False) for k in range(d)], bool).reshape(d, -1).any(axis=0)
            x = np.column_stack([batch.column(k + 2).fill_null(0.0).to_numpy() for k in range(d)]) if d else np.zeros((batch.num_rows, 0))
            for key, m in matrices.items():
                rows = np.flatnonzero(of == (-1 if key is None else key))
                step = max(1, (1 << 16) // max(1, len(times)))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    made = np.einsum("tqd,nd->ntq", m, x[some], optimize=True)
                    i, t = np.nonzero(np.arange(len(times)) < n[some][:, None])
                    gone = pa.array(empty[some][i])
                    columns = [pc.if_else(gone, pa.scalar(None, pa.float64()), pa.array(made[i, t, q])) for q in range(len(names))]
                    begin = batch.column(1).to_numpy(zero_copy_only=False)[some]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some[i])), pa.array(begin[i] + times[t]), *columns], names=schema.names)

    return chosen.mapInArrow(run, schema)


@dataclass
class Model:
    """Common to all: prediction, reconstruction, score."""

    features: list[str] = field(default_factory=list)
    delta: float = 1.0
    system: LinearSystem | None = None
    controls: list[str] = field(default_factory=list)

    def _begin(self, tsc: Collection, delta: float | None) -> None:
        self.features = list(tsc.features)
        self.delta = Checked(tsc).require(min_timesteps=2).delta if delta is None else delta

    def predict(self, initial: Collection, times: Sequence[float] | None = None, control: Collection | None = None, qois: Sequence[str] | None = None, modes: np.ndarray | None = None) -> Collection:
        """qois: the features wanted, in any order; modes: a map from states to outputs instead."""
        if list(initial.features) != self.features:
            initial = initial.select(*self.features)
        times = [0.0, self.delta] if times is None else list(times)
        if any(b <= a for a, b in zip(times, times[1:], strict=False)) or (times and times[0] < 0):
            raise CollectionError("times rise from 0 on")
        names = list(qois or self.features)
        output = modes if modes is not None else np.eye(len(self.features))[[self.features.index(q) for q in names]]
        names = [f"mode{k}" for k in range(len(output))] if modes is not None else names
        return Collection(predict_frame(self.system, initial, times, control, output, names), tuple(names), initial.id, initial.time)

    def reconstruct(self, tsc: Collection, control: Collection | None = None, n: int | None = None) -> Collection:
        """Each series predicted from its first state, at its own times."""
        n = n or tsc.n_timesteps().agg(F.max("n_timesteps")).first()[0]
        made = self.predict(tsc.initial_states(1), [k * self.delta for k in range(n)], control)
        return made.with_df(made.df.join(tsc.df.select(tsc.id, F.col(tsc.time).cast("double").alias(tsc.time)), [tsc.id, tsc.time], "left_semi"))

    def score(self, tsc: Collection, control: Collection | None = None) -> float:
        exact = tsc.with_df(tsc.df.withColumn(tsc.time, F.col(tsc.time).cast("double")))
        return metrics.score(exact, self.reconstruct(tsc, control))

    @property
    def eigenvalues(self) -> np.ndarray:
        return (self.system.parts or spectrum(self.system.matrix))[0]

    @property
    def modes(self) -> np.ndarray:
        return (self.system.parts or spectrum(self.system.matrix))[1]


@dataclass
class Dmd(Model):
    """Least-squares one-step map. rank: keep that many directions of the data; project: modes in them, else exact modes.
    generator: the logarithm of the map, per time unit. residual: drop eigenpairs whose relative residual is above it
    (or keep the best `keep`)."""

    mode: str = "spectral"
    rank: int | None = None
    project: bool = False
    generator: bool = False
    rcond: float | None = None
    residual: float | None = None
    keep: int | None = None
    residuals: np.ndarray | None = None

    def fit(self, tsc: Collection, delta: float | None = None) -> Dmd:
        self._begin(tsc, delta)
        after = [f"{f}_next" for f in self.features]
        both, n = gram.matrix(shift_pairs(tsc), self.features + after)
        d = len(self.features)
        self.fit_gram(both[:d, :d] / n, both[:d, d:] / n, both[d:, d:] / n)
        return self

    def fit_gram(self, g: np.ndarray, cross: np.ndarray, after: np.ndarray | None = None) -> None:
        """From x'x, x'x+ and x+'x+ (any common factor)."""
        parts = None
        if self.rank is None:
            a = least_squares(g, cross, self.rcond)
        else:
            # Directions and singular values of the data from x'x alone.
            values, u = np.linalg.eigh(g)
            values, u = values[::-1][: self.rank], u[:, ::-1][:, : self.rank]
            small = u.T @ cross.T @ u / values
            lam, right, left = spectrum(small)
            lifted = u @ right if self.project else (cross.T @ u / values) @ right / np.where(lam == 0, 1, lam)
            parts, a = (lam, lifted, np.linalg.pinv(lifted)), ((lifted * lam) @ np.linalg.pinv(lifted)).real
        if self.residual is not None or self.keep is not None:
            lam, right, left = parts or spectrum(a)
            self.residuals = self._residuals(lam, right, g, cross, after)
            order = np.argsort(self.residuals, kind="stable")
            good = order[: self.keep] if self.keep is not None else np.flatnonzero(self.residuals <= self.residual)
            good = np.sort(good)
            parts = (lam[good], right[:, good], np.linalg.pinv(right[:, good]))
            a = ((parts[1] * parts[0]) @ parts[2]).real
        if self.generator:
            if parts is not None or self.mode == "spectral":
                lam, right, left = parts or spectrum(a)
                parts = (np.log(lam.astype(complex)) / self.delta, right, left)
            a = logm(a).real / self.delta
        self.system = LinearSystem(a, "differential" if self.generator else "flowmap", self.mode, self.delta, parts=parts)

    @staticmethod
    def _residuals(lam, right, g, cross, after) -> np.ndarray:
        """Relative size of (K g - lambda g) for eigenfunctions given by left coordinates."""
        w = np.linalg.pinv(right).T
        out = []
        for k, v in enumerate(lam):
            c = w[:, k]
            top = c.conj() @ (after - v * cross.T - np.conj(v) * cross + abs(v) ** 2 * g) @ c
            out.append(np.sqrt(max(top.real, 0.0) / max((c.conj() @ g @ c).real, 1e-300)))
        return np.array(out)

    def pseudospectrum(self, points: np.ndarray, g: np.ndarray, cross: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Least residual that any function of the dictionary reaches at each complex point."""
        values, u = np.linalg.eigh(g)
        root = u / np.sqrt(np.maximum(values, 1e-14 * values.max()))
        out = []
        for z in points:
            form = root.T @ (after - z * cross.T - np.conj(z) * cross + abs(z) ** 2 * g) @ root
            out.append(np.sqrt(max(np.linalg.eigvalsh((form + form.conj().T) / 2)[0], 0.0)))
        return np.array(out)


@dataclass
class GeneratorDmd(Model):
    """x' = A x from finite differences."""

    mode: str = "spectral"
    scheme: str = "center"
    accuracy: int = 2
    rcond: float | None = None

    def fit(self, tsc: Collection, delta: float | None = None) -> GeneratorDmd:
        self._begin(tsc, delta)
        dots = finite_difference(tsc, self.delta, self.scheme, 1, self.accuracy, suffix="_dot")
        both, _ = gram.matrix(tsc.join_features(dots).df, self.features + [f"{f}_dot" for f in self.features])
        d = len(self.features)
        self.system = LinearSystem(least_squares(both[:d, :d], both[:d, d:], self.rcond), "differential", self.mode, self.delta)
        return self


def check_controls(tsc: Collection, needed: DataFrame, control: Collection) -> None:
    """Controls are needed, once, at each time of a state that is learnt from (`needed`: its keys), and nowhere but at times of states."""
    keys = lambda df, i, t, *marks: df.select(F.col(i).alias("i"), F.col(t).alias("t"), *(F.lit(m).alias(n) for m, n in zip(marks, "nsc", strict=True)))
    every = keys(needed, tsc.id, tsc.time, 1, 0, 0).unionByName(keys(tsc.df, tsc.id, tsc.time, 0, 1, 0)).unionByName(keys(control.df, control.id, control.time, 0, 0, 1))
    met = every.groupBy("i", "t").agg(F.max("n").alias("n"), F.max("s").alias("s"), F.sum("c").alias("c"))
    found = met.agg(F.count_if(F.expr("n = 1 AND c = 0")).alias("missing"), F.count_if(F.expr("c > 1")).alias("repeated"), F.count_if(F.expr("c > 0 AND s = 0")).alias("foreign")).first().asDict()
    refuse(found)


def refuse(found: dict[str, int]) -> None:
    """An error where keys of controls were found to be wrong."""
    if any(found.values()):
        raise CollectionError("controls don't have the keys of the states: " + ", ".join(f"{n} {kind}" for kind, n in found.items() if n))


def controlled_pairs(tsc: Collection, control: Collection, after: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """Each sample with its control and the next sample, and 1 in one of three marks where check_controls would count: a control is missing,
    repeated, or at no time of a state. Values are 0 in rows that aren't such pairs, so that one Gram matrix has both sums and counts."""
    i, t, n = tsc.id, tsc.time, tasks(tsc.df)
    lead = lambda c: F.lead(c).over(tsc.by_time)
    states = tsc.df.select(i, t, *tsc.features, *(lead(f).alias(a) for f, a in zip(tsc.features, after, strict=True)), lead(t).isNotNull().alias("_has"))
    given = control.df.groupBy(F.col(control.id).alias(i), F.col(control.time).alias(t)).agg(F.count(F.lit(1)).alias("_c"), *(F.first(u).alias(u) for u in control.features))
    met = states.repartition(n, i, t).join(given.repartition(n, i, t), [i, t], "full")
    used, found = F.col("_has") & F.col("_c").isNotNull(), (F.col("_has") & F.col("_c").isNull(), F.col("_c") > 1, F.col("_has").isNull())
    values = (F.when(used, F.col(c)).otherwise(0.0).alias(c) for c in (*tsc.features, *control.features, *after))
    return met.select(*values, *(F.when(f, 1.0).otherwise(0.0).alias(k) for f, k in zip(found, marks, strict=True)))


@dataclass
class ControlDmd(Model):
    """x+ = A x + B u."""

    rcond: float | None = None
    mode: str = "matrix"

    def fit(self, tsc: Collection, control: Collection, delta: float | None = None) -> ControlDmd:
        self._begin(tsc, delta)
        self.controls = list(control.features)
        after, marks = [f"{f}_next" for f in self.features], ["_missing", "_repeated", "_foreign"]
        d, m = len(self.features), len(self.controls)
        both, _ = gram.matrix(controlled_pairs(tsc, control, after, marks), [*self.features, *self.controls, *after, *marks])
        refuse(dict(zip((k[1:] for k in marks), np.diag(both)[-3:].round().astype(int).tolist(), strict=True)))
        both = both[:-3, :-3]
        ab = least_squares(both[: d + m, : d + m], both[: d + m, d + m :], self.rcond)
        self.system = LinearSystem(ab[:, :d], "flowmap", self.mode, self.delta, control=ab[:, d:])
        return self


@dataclass
class AffineDmd(Model):
    """x' = A x + sum of u_k B_k x, from finite differences."""

    scheme: str = "center"
    accuracy: int = 2
    rcond: float | None = None

    def fit(self, tsc: Collection, control: Collection, delta: float | None = None) -> AffineDmd:
        self._begin(tsc, delta)
        self.controls = list(control.features)
        dots = finite_difference(tsc, self.delta, self.scheme, 1, self.accuracy, suffix="_dot")
        known = tsc.join_features(dots)
        check_controls(tsc, known.df, control)
        rows = known.join_features(control).df
        rows, products = gram.kronecker(rows, self.features, self.controls)
        d, m = len(self.features), len(self.controls)
        both, _ = gram.matrix(rows, self.features + products + [f"{f}_dot" for f in self.features])
        ab = least_squares(both[: d + d * m, : d + d * m], both[: d + d * m, d + d * m :], self.rcond)
        self.system = LinearSystem(ab[:, :d], "differential", "matrix", self.delta, control=ab[:, d:].reshape(d, m, d).transpose(1, 0, 2), affine=True)
        return self


def pretrained(matrix: np.ndarray, features: Sequence[str], delta: float = 1.0, **how) -> Model:
    return Model(list(features), delta, LinearSystem(np.asarray(matrix), delta=delta, **how))
