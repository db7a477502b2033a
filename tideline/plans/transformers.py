"""Feature transformers: fit once (an aggregate, or nothing), then a projection of Column expressions.

Each has fit, transform, inverse and names; `Pipeline` chains them, `Columns` puts several side by side.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.linalg import least_squares, signs, symmetric_top
from tideline.functions.vectors import linear
from tideline.operators import gram, windows
from tideline.operators.collection import Collection, CollectionError
from tideline.operators.kernels import Kernel, gaussian


class Transformer:
    names_in: list[str]

    def fit(self, tsc: Collection) -> Transformer:
        self.names_in = list(tsc.features)
        return self

    def partial_fit(self, tsc: Collection) -> Transformer:
        if not hasattr(self, "names_in"):
            return self.fit(tsc)
        return self.checked(tsc) and self

    def checked(self, tsc: Collection) -> bool:
        if list(tsc.features) != self.names_in:
            raise CollectionError(f"fitted on {self.names_in}")
        return True

    def transform(self, tsc: Collection) -> Collection:
        raise NotImplementedError

    def fit_transform(self, tsc: Collection) -> Collection:
        return self.fit(tsc).transform(tsc)

    def inverse(self, tsc: Collection) -> Collection:
        raise CollectionError("there is no inverse")

    @staticmethod
    def project(tsc: Collection, columns: Sequence[Column], names: Sequence[str]) -> Collection:
        return tsc.with_df(tsc.df.select(tsc.id, tsc.time, *(c.alias(n) for c, n in zip(columns, names, strict=True))), names)


class Identity(Transformer):
    def __init__(self, const: bool = False, rename: bool = False) -> None:
        self.const, self.rename = const, rename

    def transform(self, tsc):
        names = [f"{f}_id" if self.rename else f for f in self.names_in]
        columns = [F.col(f) for f in self.names_in]
        return self.project(tsc, columns + [F.lit(1.0)] * self.const, names + ["const"] * self.const)

    def inverse(self, tsc):
        return self.project(tsc, [F.col(f"{f}_id" if self.rename else f) for f in self.names_in], self.names_in)


class Select(Transformer):
    def __init__(self, *features: str | int) -> None:
        self.features = features

    def transform(self, tsc):
        return tsc.select(*self.features)


class Scale(Transformer):
    """center, standard or min-max, by statistics of the fitted collection (population deviation; a constant feature is divided by 1)."""

    def __init__(self, kind: str = "standard") -> None:
        if kind not in ("center", "standard", "min-max"):
            raise CollectionError(f"kind {kind!r}")
        self.kind = kind

    def fit(self, tsc):
        super().fit(tsc)
        shift = {"center": F.avg, "standard": F.avg, "min-max": F.min}[self.kind]
        size = {"center": lambda f: F.lit(1.0), "standard": F.stddev_pop, "min-max": lambda f: F.max(f) - F.min(f)}[self.kind]
        row = tsc.df.agg(*(shift(f) for f in tsc.features), *(size(f) for f in tsc.features)).first()
        d = len(tsc.features)
        self.shift, self.size = list(row[:d]), [s if s else 1.0 for s in row[d:]]
        return self

    def transform(self, tsc):
        self.checked(tsc)
        return self.project(tsc, [(F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in zip(self.names_in, self.shift, self.size, strict=True)], self.names_in)

    def inverse(self, tsc):
        return self.project(tsc, [F.col(f) * F.lit(s) + F.lit(m) for f, m, s in zip(self.names_in, self.shift, self.size, strict=True)], self.names_in)


class Principal(Transformer):
    """Principal components from sums of products. partial_fit adds further batches exactly: the state is (rows, sums, products)."""

    def __init__(self, n: int | None = None) -> None:
        self.n, self.rows, self.sums, self.products = n, 0, None, None

    def fit(self, tsc):
        self.rows, self.sums, self.products = 0, None, None
        return self.partial_fit(tsc)

    def partial_fit(self, tsc):
        if self.rows:
            self.checked(tsc)
        self.names_in = list(tsc.features)
        d = len(self.names_in)
        both, n = gram.matrix(tsc.df.withColumn("_one", F.lit(1.0)), [*self.names_in, "_one"])
        self.rows += n
        self.sums = both[:d, d] if self.sums is None else self.sums + both[:d, d]
        self.products = both[:d, :d] if self.products is None else self.products + both[:d, :d]
        self.mean = self.sums / self.rows
        covariance = (self.products - self.rows * np.outer(self.mean, self.mean)) / max(self.rows - 1, 1)
        self.variances, vectors = symmetric_top(covariance, self.n or d)
        self.components = (vectors * signs(vectors)).T
        return self

    def transform(self, tsc):
        self.checked(tsc)
        centred = [F.col(f) - F.lit(float(m)) for f, m in zip(self.names_in, self.mean, strict=True)]
        return self.project(tsc, [linear(centred, row.tolist()) for row in self.components], [f"pca{i}" for i in range(len(self.components))])

    def inverse(self, tsc):
        columns = [F.col(f) for f in tsc.features]
        return self.project(tsc, [linear(columns, row.tolist()) + F.lit(float(m)) for row, m in zip(self.components.T, self.mean, strict=True)], self.names_in)


class Takens(Transformer):
    def __init__(self, delays: int = 10, lag: int = 0, frequency: int = 1, kappa: float = 0.0) -> None:
        self.how = dict(delays=delays, lag=lag, frequency=frequency, kappa=kappa)
        self.lost = windows.delay_indices(delays, lag, frequency)[-1]

    def transform(self, tsc):
        self.checked(tsc)
        return windows.takens(tsc, **self.how)

    def inverse(self, tsc):
        return tsc.select(*self.names_in)


class FiniteDifference(Transformer):
    def __init__(self, delta: float, scheme: str = "center", order: int = 1, accuracy: int = 2) -> None:
        self.how = dict(delta=delta, scheme=scheme, order=order, accuracy=accuracy)

    def transform(self, tsc):
        return windows.finite_difference(tsc, **self.how, shift_index=True, suffix=f"_dot{self.how['order']}")


class MovingAverage(Transformer):
    def __init__(self, window: int = 3) -> None:
        self.window = window

    def transform(self, tsc):
        return windows.moving_average(tsc, self.window)


class Polynomial(Transformer):
    """Monomials up to a degree: graded, in order of combinations; first-order terms only if asked for."""

    def __init__(self, degree: int = 2, interaction_only: bool = False, bias: bool = False, first_order: bool = False) -> None:
        self.degree, self.interaction_only, self.bias, self.first_order = degree, interaction_only, bias, first_order

    def terms(self) -> list[tuple[int, ...]]:
        pick = itertools.combinations if self.interaction_only else itertools.combinations_with_replacement
        degrees = ([0] if self.bias else []) + ([1] if self.first_order else []) + list(range(2, self.degree + 1))
        return [t for k in degrees for t in pick(range(len(self.names_in)), k)]

    def name(self, term: tuple[int, ...]) -> str:
        powers = [(self.names_in[i], len(list(g))) for i, g in itertools.groupby(term)]
        return " ".join(f if p == 1 else f"{f}^{p}" for f, p in powers) or "1"

    def transform(self, tsc):
        self.checked(tsc)
        columns = []
        for term in self.terms():
            c = F.lit(1.0) if not term else F.col(self.names_in[term[0]])
            for i in term[1:]:
                c = c * F.col(self.names_in[i])
            columns.append(c)
        return self.project(tsc, columns, [self.name(t) for t in self.terms()])


class Lambdas(Transformer):
    """User functions from Column to Column on each feature: `f_lambda<i>`."""

    def __init__(self, functions: Sequence[Callable[[Column], Column]]) -> None:
        self.functions = list(functions)

    def transform(self, tsc):
        pairs = [(f, i, g) for f in self.names_in for i, g in enumerate(self.functions)]
        return self.project(tsc, [g(F.col(f)) for f, _, g in pairs], [f"{f}_lambda{i}" for f, i, _ in pairs])


class FourierFeatures(Transformer):
    """sin and cos of seeded random projections."""

    def __init__(self, n: int = 10, sigma: float = 1.0, seed: int = 1) -> None:
        self.n, self.sigma, self.seed = n, sigma, seed

    def fit(self, tsc):
        super().fit(tsc)
        self.weights = np.random.default_rng(self.seed).normal(0, 1 / self.sigma, (self.n, len(self.names_in)))
        return self

    def transform(self, tsc):
        xs = [F.col(f) for f in self.names_in]
        waves = [linear(xs, row.tolist()) for row in self.weights]
        return self.project(tsc, [F.sin(w) for w in waves] + [F.cos(w) for w in waves], [f"sin{i}" for i in range(self.n)] + [f"cos{i}" for i in range(self.n)])


class RadialBasis(Transformer):
    """A kernel around centres: all rows of a small collection, a seeded sample of `n`, the initial states, or given ones. Inverse: least squares."""

    def __init__(self, kernel: Kernel | None = None, centers: str | np.ndarray = "random", n: int = 10, seed: int = 1) -> None:
        self.kernel, self.centers, self.n, self.seed = kernel or gaussian(), centers, n, seed

    def fit(self, tsc):
        super().fit(tsc)
        if isinstance(self.centers, str):
            mixed = F.xxhash64(F.lit(self.seed), tsc.id, tsc.time)
            rows = {"random": lambda: tsc.df.orderBy(mixed, tsc.id, tsc.time).limit(self.n), "all_data": lambda: tsc.df.orderBy(tsc.id, tsc.time), "initial_condition": lambda: tsc.initial_states(1).df.orderBy(tsc.id)}[self.centers]()
            self.points = np.array(rows.select(*self.names_in).toArrow().to_pandas(), float)
        else:
            self.points = np.asarray(self.centers, float)
        out = self.transform(tsc)
        joined, m = out.join_features(tsc), len(self.points)
        both, _ = gram.matrix(joined.df, joined.features)
        self.back = least_squares(both[:m, :m], both[:m, m:])
        return self

    def transform(self, tsc):
        columns = []
        for point in self.points:
            gaps = [F.col(f) - F.lit(float(p)) for f, p in zip(self.names_in, point, strict=True)]
            d2 = gaps[0] * gaps[0]
            for g in gaps[1:]:
                d2 = d2 + g * g
            columns.append(self.kernel.of(d2 if self.kernel.metric == "sqeuclidean" else F.sqrt(d2)))
        return self.project(tsc, columns, [f"rbf{i}" for i in range(len(columns))])

    def inverse(self, tsc):
        return self.project(tsc, [linear([F.col(f) for f in tsc.features], row.tolist()) for row in self.back], self.names_in)


class Pipeline(Transformer):
    def __init__(self, steps: Sequence[Transformer]) -> None:
        self.steps = list(steps)

    def __getitem__(self, part: slice) -> Pipeline:
        return Pipeline(self.steps[part])

    def fit(self, tsc):
        self.fit_transform(tsc)
        return self

    def fit_transform(self, tsc):
        self.names_in = list(tsc.features)
        for step in self.steps:
            tsc = step.fit_transform(tsc)
        self.names_out = list(tsc.features)
        return tsc

    def partial_fit(self, tsc):
        self.names_in = list(tsc.features)
        for step in self.steps:
            tsc = step.partial_fit(tsc).transform(tsc)
        self.names_out = list(tsc.features)
        return self

    def transform(self, tsc):
        for step in self.steps:
            tsc = step.transform(tsc)
        return tsc

    def inverse(self, tsc):
        for step in reversed(self.steps):
            tsc = step.inverse(tsc)
        return tsc


class Columns(Transformer):
    """Several transformers side by side, each on its own features; keys that all of them have. remainder: pass other features on."""

    def __init__(self, parts: Sequence[tuple[Transformer, Sequence[str]]], remainder: bool = False) -> None:
        self.parts, self.remainder = list(parts), remainder

    def fit(self, tsc):
        super().fit(tsc)
        for t, features in self.parts:
            t.fit(tsc.select(*features))
        return self

    def transform(self, tsc):
        out = None
        for t, features in self.parts:
            made = t.transform(tsc.select(*features))
            out = made if out is None else out.join_features(made)
        if self.remainder:
            used = {f for _, features in self.parts for f in features}
            if rest := [f for f in tsc.features if f not in used]:
                out = out.join_features(tsc.select(*rest))
        return out
