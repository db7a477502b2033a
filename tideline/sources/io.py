"""Collections and point clouds from files, arrays and frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.collection import Collection, CollectionError, running_before

__all__ = ["concat", "control_sequence", "from_array", "from_csv", "from_parquet", "from_shift_pairs", "from_single_series", "from_tensor", "initial_condition", "point_cloud", "regular_mesh", "to_csv", "to_pandas_series"]


def from_parquet(spark: SparkSession, path: str, **roles) -> Collection:
    return Collection.of(spark.read.parquet(path), **roles)


def from_csv(spark: SparkSession, path: str, schema: str | None = None, **roles) -> Collection:
    """CSV with a header line; the first two columns are id and time unless roles say otherwise."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return Collection.of(df, **{"id": df.columns[0], "time": df.columns[1], **roles})


def to_csv(tsc: Collection, path: str) -> None:
    tsc.df.write.mode("overwrite").option("header", True).csv(path)


def to_pandas_series(tsc: Collection) -> pd.DataFrame:
    """A single series as a pandas frame with the time as its index; for plotting and other libraries."""
    if tsc.ids().limit(2).count() != 1:
        raise CollectionError("exactly one series is wanted")
    return tsc.df.drop(tsc.id).toPandas().set_index(tsc.time).sort_index()


def from_tensor(spark: SparkSession, tensor: np.ndarray, names: Sequence[str] | None = None, ids: Sequence[int] | None = None, times: Sequence | None = None) -> Collection:
    """An array of (series, time, feature)."""
    s, t, f = np.asarray(tensor).shape
    names = list(names or (f"feature{i}" for i in range(f)))
    frame = pd.DataFrame(np.asarray(tensor, float).reshape(s * t, f), columns=names)
    frame.insert(0, "time", np.tile(np.arange(t) if times is None else np.asarray(times), s))
    frame.insert(0, "id", np.repeat(np.arange(s) if ids is None else np.asarray(ids), t))
    return Collection.of(spark.createDataFrame(frame), features=names)


def from_array(spark: SparkSession, array: np.ndarray, times: Sequence | None = None, names: Sequence[str] | None = None, id: int = 0) -> Collection:
    return from_tensor(spark, np.asarray(array)[None], names, [id], times)


def from_single_series(df: DataFrame, time: str, id: int = 0) -> Collection:
    return Collection.of(df.withColumn("id", F.lit(id).cast("long")), time=time)


def from_shift_pairs(left: DataFrame, right: DataFrame, pair: str, times: tuple = (0, 1)) -> Collection:
    """Each pair of rows of left and right with the same `pair` number is a series of two samples."""
    sides = [d.withColumn("time", F.lit(t)) for d, t in zip((left, right), times, strict=True)]
    return Collection.of(sides[0].unionByName(sides[1]), id=pair)


def concat(frames: Sequence[Collection]) -> Collection:
    """All series of all frames, numbered 0, 1, ... in order of frame and id."""
    first = frames[0]
    if any(set(f.features) != set(first.features) for f in frames):
        raise CollectionError("the frames have different features")
    union = None
    for i, f in enumerate(frames):
        one = f.df.select(F.lit(i).alias("_frame"), F.col(f.id).alias(first.id), F.col(f.time).alias(first.time), *first.features)
        union = one if union is None else union.unionByName(one)
    keys = union.select("_frame", first.id).distinct().withColumn("_one", F.lit(1))
    fresh = running_before(keys, ["_frame", first.id], "_one", "_new").select("_frame", first.id, "_new")
    out = union.join(fresh, ["_frame", first.id]).withColumn(first.id, F.col("_new"))
    return first.with_df(out.select(*first.df.columns))


def initial_condition(spark: SparkSession, states: np.ndarray, time=0, names: Sequence[str] | None = None, ids: Sequence[int] | None = None) -> Collection:
    """One state for each series at one time."""
    return from_tensor(spark, np.atleast_2d(states)[:, None, :], names, ids, [time])


def control_sequence(spark: SparkSession, controls: np.ndarray, names: Sequence[str], delta: float | None = None, times: Sequence | None = None, id: int = 0) -> Collection:
    return from_array(spark, controls, np.arange(len(controls)) * delta if times is None else times, names, id)


def regular_mesh(spark: SparkSession, low: tuple[float, float], high: tuple[float, float], nx: int, ny: int) -> DataFrame:
    """x, y of a grid with nx by ny points, edges included."""
    step = [(h - l) / max(n - 1, 1) for l, h, n in zip(low, high, (nx, ny), strict=True)]
    i = F.col("id")
    return spark.range(nx * ny).select((F.lit(float(low[0])) + (i % nx) * F.lit(step[0])).alias("x"), (F.lit(float(low[1])) + F.floor(i / nx) * F.lit(step[1])).alias("y"))


def point_cloud(df: DataFrame, id: str, vector: str) -> DataFrame:
    """point_id and x (array<double>) of rows with a whole, finite vector."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(id).cast("long").alias("point_id"), x.alias("x")).where(F.col("x").isNotNull() & whole)
