"""Extended dynamic mode decomposition: a dictionary of transformers, a linear model in its space, and the way back."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.linalg import least_squares, spectrum
from tideline.functions.vectors import linear
from tideline.operators import gram, metrics
from tideline.operators.checks import Checked
from tideline.operators.collection import Collection, CollectionError
from tideline.operators.dynamics import ControlDmd, Dmd, Model, projected
from tideline.operators.splits import kfold_series, splits
from tideline.operators.windows import finite_difference, shift_pairs, takens
from tideline.plans.session import dropped, shared_folder, written
from tideline.plans.transformers import Identity, Pipeline, Principal, Transformer


class Edmd:
    """dictionary: transformers in a row. include_state: the original features stay in the dictionary, so the way back is a
    selection; else it is least squares. stepwise: predict one step, go back, lift anew."""

    def __init__(self, dictionary: Sequence[Transformer] = (), model: Model | None = None, include_state: bool = True, stepwise: bool = False) -> None:
        self.pipeline, self.model = Pipeline(list(dictionary) or [Identity()]), model or Dmd()
        self.include_state, self.stepwise = include_state, stepwise

    def __getitem__(self, part: slice) -> Pipeline:
        return self.pipeline[part]

    @property
    def additive(self) -> bool:
        """Whether sums over series are all that a fit needs: the dictionary learns nothing and holds the state."""
        return type(self.model) is Dmd and self.include_state and not self.stepwise and all(type(t).fit is Transformer.fit for t in self.pipeline.steps)

    def _lift(self, tsc: Collection, fit: bool) -> Collection:
        made = self.pipeline.fit_transform(tsc) if fit else self.pipeline.transform(tsc)
        if self.include_state and (missing := [f for f in tsc.features if f not in made.features]):
            made = tsc.select(*missing).join_features(made)
        return made

    def fit(self, tsc: Collection, control: Collection | None = None) -> Edmd:
        checked = Checked(tsc).require(min_timesteps=2)
        self.features, self.delta = list(tsc.features), checked.delta
        lifted = self._lift(tsc, True)
        self.names = list(lifted.features)
        rows = lifted.n_timesteps().agg(F.max("n_timesteps")).first()[0]
        self.n_samples_ic = checked.row["most_n"] - rows + 1
        self.controls = list(control.features) if control is not None else []
        self.model.fit(lifted, delta=self.delta) if control is None else self.model.fit(lifted, control, delta=self.delta)
        if all(f in self.names for f in self.features):
            self.back = np.eye(len(self.names))[[self.names.index(f) for f in self.features]]
        else:
            both, _ = gram.matrix(lifted.join_features(tsc).df, self.names + self.features)
            n = len(self.names)
            self.back = least_squares(both[:n, :n], both[:n, n:])
        return self

    def partial_fit(self, tsc: Collection) -> Edmd:
        """Adds a batch to the model's sums (a Dmd without rank): the same as one fit on all batches' series."""
        checked = Checked(tsc).require(min_timesteps=2)
        if not hasattr(self, "sums"):
            self.features, self.delta = list(tsc.features), checked.delta
            self.sums, self.pairs = 0.0, 0
        self.pipeline.partial_fit(tsc)
        lifted = self._lift(tsc, False)
        self.names = list(lifted.features)
        both, n = gram.matrix(shift_pairs(lifted), self.names + [f"{f}_next" for f in self.names])
        self.sums, self.pairs, d = self.sums + both, self.pairs + n, len(self.names)
        self.model.features, self.model.delta = self.names, self.delta
        self.model.fit_gram(self.sums[:d, :d], self.sums[:d, d:], self.sums[d:, d:])
        self.n_samples_ic = checked.row["most_n"] - lifted.n_timesteps().agg(F.max("n_timesteps")).first()[0] + 1
        if missing := [f for f in self.features if f not in self.names]:
            raise CollectionError(f"the dictionary of a model in batches has no {missing}: the way back would need all batches")
        self.back = np.eye(d)[[self.names.index(f) for f in self.features]]
        return self

    def transform(self, tsc: Collection) -> Collection:
        return self._lift(tsc, False)

    def inverse(self, lifted: Collection) -> Collection:
        columns = [F.col(f) for f in self.names]
        return lifted.with_df(lifted.df.select(lifted.id, lifted.time, *(linear(columns, row.tolist()).alias(f) for f, row in zip(self.features, self.back, strict=True))), self.features)

    @property
    def eigenvalues(self) -> np.ndarray:
        return self.model.eigenvalues

    @property
    def modes(self) -> np.ndarray:
        """Features by eigenvectors."""
        return self.back @ self.model.modes

    def eigenfunctions(self, tsc: Collection) -> DataFrame:
        """id, time and real and imaginary part of each Koopman eigenfunction."""
        left = (self.model.system.parts or spectrum(self.model.system.matrix))[2]
        lifted = self.transform(tsc)
        xs = [F.col(f) for f in self.names]
        columns = [linear(xs, part.tolist()).alias(f"koop_eigfunc{k}_{kind}") for k, row in enumerate(left) for kind, part in (("re", row.real), ("im", row.imag))]
        return lifted.df.select(lifted.id, lifted.time, *columns)

    def ranked_triplets(self, tsc: Collection) -> list[int]:
        """Eigenpairs by the mean size, over initial conditions, of mode length times eigenfunction; largest first."""
        values = self.eigenfunctions(tsc.initial_states(self.n_samples_ic))
        n = len(self.eigenvalues)
        row = values.agg(*(F.avg(F.hypot(f"koop_eigfunc{k}_re", f"koop_eigfunc{k}_im")) for k in range(n))).first()
        weight = np.linalg.norm(self.modes, axis=0) * np.array(list(row), float)
        return np.argsort(-weight, kind="stable").tolist()

    def predict(self, initial: Collection, times: Sequence[float] | None = None, control: Collection | None = None, qois: Sequence[str] | None = None) -> Collection:
        """initial: n_samples_ic rows of each series; times count from its last row."""
        wrong = initial.n_timesteps().where(F.col("n_timesteps") != self.n_samples_ic)
        if not wrong.isEmpty():
            raise CollectionError(f"initial conditions have {self.n_samples_ic} samples")
        times = [0.0, self.delta] if times is None else list(times)
        names = list(qois or self.features)
        if self.stepwise:
            return self._stepwise(initial, times, names, control)
        lifted = self.transform(initial).final_states(1)
        back = self.back[[self.features.index(q) for q in names]]
        made = self.model.predict(lifted, times, control, modes=back)
        return made.with_df(made.df.select(made.id, made.time, *(F.col(f"mode{k}").alias(n) for k, n in enumerate(names))), names)

    def _stepwise(self, initial: Collection, times: Sequence[float], names: Sequence[str], control: Collection | None = None) -> Collection:
        """A step at a time: lift the last n_samples_ic rows, step, go back. Each step is a table in the shared folder, so a plan reads
        two folders however many steps there are. control: from a series' last initial time on."""
        steps = round(times[-1] / self.delta)
        if any(abs(t / self.delta - round(t / self.delta)) > 1e-9 for t in times):
            raise CollectionError("stepwise prediction moves in whole steps")
        i, t, n, spark = initial.id, initial.time, self.n_samples_ic, initial.spark
        root = shared_folder(spark, "stepwise")
        at = F.row_number().over(Window.partitionBy(i).orderBy(F.desc(t)))
        begin = initial.df.select(i, F.col(t).cast("double").alias(t), *self.features, (1 - at).cast("long").alias("_step"))
        begin.write.parquet(f"{root}/begin")
        read = lambda folders: spark.read.schema(begin.schema).parquet(*(f"{root}/{x}" for x in folders))
        for k in range(1, steps + 1):
            folders = [*(["begin"] if k <= n else []), *range(max(1, k - n), k)]
            now = initial.with_df(read(folders).where(F.col("_step") >= k - n).drop("_step"), self.features)
            lifted = self.transform(now).final_states(1)
            if control is None:
                step = self.model.predict(lifted, [self.delta], modes=self.back).df
            else:
                held = control.df.join(lifted.df.select(F.col(i).alias(control.id), F.col(t).alias("_from")), control.id)
                held = control.with_df(held.where(F.col(control.time) >= F.col("_from") - 1e-9 * self.delta).drop("_from"))
                made = self.model.predict(lifted, [0.0, self.delta], held, modes=self.back)
                step = made.final_states(1).df
            step.select(i, t, *(F.col(f"mode{j}").alias(f) for j, f in enumerate(self.features)), F.lit(k).cast("long").alias("_step")).write.parquet(f"{root}/{k}")
        kept = read(["begin", *range(1, steps + 1)]).where(F.col("_step").isin([round(x / self.delta) for x in times]))
        return initial.with_df(kept.select(i, t, *names), names)

    def reconstruct(self, tsc: Collection, control: Collection | None = None) -> Collection:
        n = tsc.n_timesteps().agg(F.max("n_timesteps")).first()[0] - self.n_samples_ic + 1
        made = self.predict(tsc.initial_states(self.n_samples_ic), [k * self.delta for k in range(n)], control)
        return made.with_df(made.df.join(tsc.df.select(tsc.id, F.col(tsc.time).cast("double").alias(tsc.time)), [tsc.id, tsc.time], "left_semi"))

    def score(self, tsc: Collection, control: Collection | None = None, scaling: str | None = "min-max") -> float:
        made = self.reconstruct(tsc, control)
        true = tsc.with_df(tsc.df.withColumn(tsc.time, F.col(tsc.time).cast("double")).join(made.df.select(tsc.id, tsc.time), [tsc.id, tsc.time], "left_semi"))
        return metrics.score(true, made, scaling=scaling)

    def window_scores(self, tsc: Collection, size: int, offset: int, metric: str = "rmse") -> DataFrame:
        """Error of predicting each sliding window of each series from its first samples."""
        rows = tsc.windows(size, offset, per_series=True).withColumn("_old", F.col(tsc.id)).withColumn(tsc.id, F.xxhash64(tsc.id, "window")).persist()
        cut = tsc.with_df(rows.select(tsc.id, F.col(tsc.time).cast("double").alias(tsc.time), *tsc.features))
        made = self.predict(cut.initial_states(self.n_samples_ic), [k * self.delta for k in range(size - self.n_samples_ic + 1)])
        true = cut.with_df(cut.df.join(made.df.select(tsc.id, tsc.time), [tsc.id, tsc.time], "left_semi"))
        errors = metrics.score_frame(true, made, metric, "timeseries", check=False)
        return errors.join(rows.select(tsc.id, "_old", "window").distinct(), tsc.id).drop(tsc.id).withColumnRenamed("_old", tsc.id)


@dataclass
class Search:
    """Best parameters, their mean score, all candidates with theirs, and the best model fitted anew on all series (if asked for)."""

    best: dict
    score: float
    tried: list[tuple[dict, float]]
    model: Edmd | None = None

    def __iter__(self):
        return iter((self.best, self.score, self.tried))


def grid_search(build, grid: dict[str, Sequence], tsc: Collection, split: dict, workers: int = 4, refit: bool = False, error_score: float | None = None) -> Search:
    """Best parameters of build(**parameters) by mean score over the splits; of equal ones the first.

    A candidate that fails ends the search, or, with an error_score, has that for a score (nan: never best). Where folds are sets of
    series and a candidate is a plain linear model on a dictionary that learns nothing itself, its models come from one pass: the sums
    of all series less those of a fold; another pass scores all folds. Other candidates are fitted split by split."""
    candidates = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    shared = split.get("kind") == "series" and all(isinstance(m := build(**p), Edmd) and m.additive for p in candidates)
    if shared:
        checked = Checked(tsc).require(min_timesteps=2)
        rows = written(kfold_series(tsc, split.get("k", 3), split.get("seed")), "folds")
        of = written(rows.select(tsc.id, "fold").distinct(), "fold-of-series")
        data = tsc.with_df(rows.drop("fold"))
        attempt = lambda p: float(np.mean(fold_scores(build(**p), data, of, checked)))
    else:
        folds = [(a.with_df(a.df.persist()), b.with_df(b.df.persist())) for a, b in splits(tsc, **split)]
        attempt = lambda p: float(np.mean([deepcopy(build(**p)).fit(train).score(test) for train, test in folds]))

    def run(parameters: dict) -> float:
        try:
            return attempt(parameters)
        except Exception:
            if error_score is None:
                raise
            return float(error_score)

    with ThreadPoolExecutor(workers) as pool:
        scores = list(pool.map(run, candidates))
    if shared:
        dropped(rows, of)
    else:
        for pair in folds:
            for side in pair:
                side.df.unpersist()
    if np.isnan(scores).all():
        raise CollectionError("every candidate failed")
    best = int(np.nanargmax(scores))
    model = build(**candidates[best]).fit(tsc) if refit else None
    return Search(candidates[best], scores[best], list(zip(candidates, scores, strict=True)), model)


def fold_scores(model: Edmd, tsc: Collection, folds: DataFrame, checked: Checked) -> list[float]:
    """The score on each fold (id, fold) of the model fitted on the series of all others."""
    model.features, delta = list(tsc.features), checked.delta
    lifted = model._lift(tsc, True)
    names, d = list(lifted.features), len(lifted.features)
    back = np.eye(d)[[names.index(f) for f in model.features]]
    sums = gram.matrices(shift_pairs(lifted).join(folds, tsc.id), names + [f"{f}_next" for f in names], "fold")
    total, n = sum(m for m, _ in sums.values()), sum(k for _, k in sums.values())
    count = F.count(F.lit(1)).over(Window.partitionBy(tsc.id))
    at = F.row_number().over(Window.partitionBy(tsc.id).orderBy(tsc.time))
    first = lifted.with_df(lifted.df.withColumns({"_n": count, "_at": at}).where("_at = 1").drop("_at").join(folds, tsc.id))
    most = checked.row["most_n"]
    steps, matrices = np.arange(most) * delta, {}
    for fold, (m, k) in sums.items():
        one = deepcopy(model.model)
        one.features, one.delta = names, delta
        g, rows = total - m, n - k
        if not rows:
            raise CollectionError(f"without fold {fold} there is nothing to learn from")
        one.fit_gram(g[:d, :d] / rows, g[:d, d:] / rows, g[d:, d:] / rows)
        matrices[fold] = np.array([back @ one.system.propagator(float(t)) for t in steps])
    made = projected(first, matrices, steps, [f"_p{k}" for k in range(len(model.features))], "fold", "_n")
    true = tsc.df.select(tsc.id, F.col(tsc.time).cast("double").alias(tsc.time), *tsc.features).join(folds, tsc.id)
    errors = [c for k, f in enumerate(model.features) for c in (F.sqrt(F.avg((F.col(f) - F.col(f"_p{k}")) ** 2)).alias(f"e{k}"), (F.max(f) - F.min(f)).alias(f"s{k}"))]
    found = true.join(made, [tsc.id, tsc.time]).groupBy("fold").agg(*errors).orderBy("fold").collect()
    return [-float(np.mean([r[f"e{k}"] / (r[f"s{k}"] or 1.0) for k in range(len(model.features))])) for r in found]


class Havok:
    """Delay coordinates, their principal directions, and a linear model of their derivatives forced by the last of them."""

    def __init__(self, delays: int = 10, rank: int = 5, delta: float = 1.0) -> None:
        self.delays, self.rank, self.delta = delays, rank, delta

    def fit(self, tsc: Collection) -> Havok:
        self.principal = Principal(self.rank)
        v = self.principal.fit_transform(takens(tsc, self.delays))
        dots = finite_difference(v, self.delta, accuracy=4, suffix="_dot")
        names = list(v.features)
        both, _ = gram.matrix(v.join_features(dots).df, names + [f"{n}_dot" for n in names[:-1]])
        r = self.rank
        ab = least_squares(both[:r, :r], both[:r, r:])
        self.matrix, self.forcing = ab[:, : r - 1], ab[:, r - 1 :]
        return self


__all__ = ["ControlDmd", "Edmd", "Havok", "grid_search"]
