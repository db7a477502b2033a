"""Errors between true and predicted collections: per series, per time or per feature, from one join and one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.checks import same_keys
from tideline.operators.collection import Collection, CollectionError

EPS = 2.220446049250313e-16


def _error(metric: str, y: Column, p: Column) -> Column:
    e = y - p
    return {
        "rmse": lambda: F.sqrt(F.avg(e * e)),
        "mse": lambda: F.avg(e * e),
        "rrmse": lambda: F.sqrt(F.try_divide(F.avg(e * e), F.sum(y * y))),
        "mae": lambda: F.avg(F.abs(e)),
        "mape": lambda: F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS))),
        "medae": lambda: F.percentile(F.abs(e), 0.5),
        "max": lambda: F.max(F.abs(e)),
        "linf": lambda: F.max(F.abs(e)),
        "l2": lambda: F.sqrt(F.sum(e * e)),
    }[metric]()


def scale(true: Collection, other: Collection, kind: str | None) -> tuple[DataFrame, DataFrame]:
    """Both collections scaled by statistics of the true one (min-max, standard), or each row by its length (l2-normalize)."""
    if kind in (None, "id"):
        return true.df, other.df
    if kind == "l2-normalize":
        def unit(tsc: Collection) -> DataFrame:
            norm = F.sqrt(sum((F.col(f) * F.col(f) for f in tsc.features), F.lit(0.0)))
            return tsc.df.withColumns({f: F.coalesce(F.try_divide(F.col(f), norm), F.lit(0.0)) for f in tsc.features})
        return unit(true), unit(other)
    if kind == "min-max":
        shift, size = F.min, lambda f: F.max(f) - F.min(f)
    elif kind == "standard":
        shift, size = F.avg, F.stddev_pop
    else:
        raise CollectionError(f"scaling {kind!r}")
    stats = true.df.agg(*(shift(f).alias(f"_m_{f}") for f in true.features), *(size(f).alias(f"_s_{f}") for f in true.features))

    def scaled(df: DataFrame) -> DataFrame:
        joined = df.crossJoin(F.broadcast(stats))  # one row
        joined = joined.withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}")) for f in true.features})
        return joined.select(*df.columns)

    return scaled(true.df), scaled(other.df)


def score_frame(true: Collection, predicted: Collection, metric: str = "rmse", mode: str = "feature", scaling: str | None = None, multioutput: str | Sequence[float] = "raw_values", weight: str | None = None, check: bool = True) -> DataFrame:
    """mode timeseries: a row for each id; timestep: for each time; feature: one row. Columns are the features, or `score` if
    multioutput is uniform_average or a list of weights. weight: a column of `true` that weighs samples (averages only).
    A zero norm makes rrmse null."""
    if check and not same_keys(true, predicted):
        raise CollectionError("the collections have different keys")
    if set(true.features) != set(predicted.features):
        raise CollectionError("the collections have different features")
    left, right = scale(true, predicted, scaling)
    right = right.select(F.col(predicted.id).alias(true.id), F.col(predicted.time).alias(true.time), *(F.col(f).alias(f"_p_{f}") for f in true.features))
    both = left.join(right, [true.id, true.time])
    keys = {"timeseries": [true.id], "timestep": [true.time], "feature": []}[mode]

    def one(f: str) -> Column:
        y, p = F.col(f), F.col(f"_p_{f}")
        if weight is None:
            return _error(metric, y, p)
        w = F.col(weight)
        mean = lambda c: F.try_divide(F.sum(w * c), F.sum(w))
        e = y - p
        kinds = {"mse": lambda: mean(e * e), "rmse": lambda: F.sqrt(mean(e * e)), "mae": lambda: mean(F.abs(e)), "mape": lambda: mean(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS)))}
        if metric not in kinds:
            raise CollectionError(f"{metric} takes no weights")
        return kinds[metric]()

    columns = [one(f).alias(f) for f in true.features]
    out = both.groupBy(*keys).agg(*columns) if keys else both.agg(*columns)
    if multioutput == "raw_values":
        return out
    weights = [1.0] * len(true.features) if multioutput == "uniform_average" else list(multioutput)
    total = sum((F.col(f) * w for f, w in zip(true.features, weights, strict=True)), F.lit(0.0)) / F.lit(sum(weights))
    return out.select(*keys, total.alias("score"))


def score(true: Collection, predicted: Collection, metric: str = "rmse", mode: str = "feature", scaling: str | None = "min-max", greater_is_better: bool = False, check: bool = False) -> float:
    """Mean of the errors, negative unless greater is better; the default is what models use, whose predictions have the true keys."""
    out = score_frame(true, predicted, metric, mode, scaling, "uniform_average", check=check).agg(F.avg("score")).first()[0]
    return out if greater_is_better else -out
