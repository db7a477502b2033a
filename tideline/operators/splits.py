"""Folds for cross-validation as columns: a split is a predicate on `fold`, never a copy of the rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.checks import Checked, overlapping_times
from tideline.operators.collection import Collection, CollectionError, running_before


def fold_of(index: Column, n: Column, k: int) -> Column:
    """Contiguous folds of n things: the first n mod k have one more than the others."""
    big, size = n % k, F.floor(n / F.lit(k)).cast("long")
    edge = big * (size + 1)
    return F.when(index < edge, F.floor(index / (size + 1))).otherwise(big + F.floor(F.try_divide(index - edge, size))).cast("int")


def _folds(tsc: Collection, by: str, k: int, seed: int | None) -> DataFrame:
    keys = tsc.df.select(by).distinct().withColumn("_one", F.lit(1))
    order = [by]
    if seed is not None:
        keys, order = keys.withColumn("_mix", F.xxhash64(F.lit(seed), by)), ["_mix", by]
    keys = running_before(keys, order, "_one", "_i").crossJoin(F.broadcast(keys.agg(F.count(F.lit(1)).alias("_n"))))
    return tsc.df.join(keys.select(by, fold_of(F.col("_i"), F.col("_n"), k).alias("fold")), by)


def kfold_series(tsc: Collection, k: int = 3, seed: int | None = None) -> DataFrame:
    """Rows with the fold (0 to k-1) of their series; shuffled by a seeded hash if a seed is given."""
    return _folds(tsc, tsc.id, k, seed)


def kfold_time(tsc: Collection, k: int = 3) -> DataFrame:
    """Rows with the fold of their time among all times."""
    return _folds(tsc, tsc.time, k, None)


def window_folds(tsc: Collection, length: int, offset: int = 0) -> DataFrame:
    """Rows with the number of the test window they are in, or null. Each series is cut from its end backwards into windows of
    `length` samples, `offset` samples apart; full windows only. Numbers run over all series, in order of id, from each one's end."""
    back = F.row_number().over(Window.partitionBy(tsc.id).orderBy(F.desc(tsc.time))) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(tsc.id))
    step = length + offset
    rows = tsc.df.withColumn("_b", back).withColumn("_w", F.floor(F.col("_b") / F.lit(step)))
    inside = (F.col("_b") % step < length) & (F.col("_w") * step + length <= total)
    rows = rows.withColumn("_w", F.when(inside, F.col("_w")))
    counts = rows.groupBy(tsc.id).agg(F.coalesce(F.max("_w") + 1, F.lit(0)).alias("_k"))
    begin = running_before(counts, [tsc.id], "_k", "_begin").select(tsc.id, "_begin")
    return rows.join(begin, tsc.id).withColumn("window", F.col("_w") + F.col("_begin")).drop("_b", "_w", "_begin")


def _cut(tsc: Collection, rows: DataFrame, test: Column, least: int | None) -> tuple[Collection, Collection]:
    """Train and test rows; train series are cut where the test rows were, so that no pair of samples spans the hole."""
    marked = rows.withColumn("_test", F.coalesce(test, F.lit(False)).cast("int"))
    hole = F.sum("_test").over(Window.partitionBy(tsc.id).orderBy(tsc.time))
    train = marked.withColumn("_part", hole).where("_test = 0")
    if least is not None:
        train = train.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(tsc.id, "_part"))).where(F.col("_n") >= least)
    parts = train.select(tsc.id, "_part").distinct().withColumn("_one", F.lit(1))
    new = running_before(parts, [tsc.id, "_part"], "_one", "_new").select(tsc.id, "_part", "_new")
    train = train.join(new, [tsc.id, "_part"]).withColumn(tsc.id, F.col("_new"))
    return tsc.with_df(train.select(*tsc.df.columns)), tsc.with_df(marked.where("_test = 1").select(*tsc.df.columns))


def splits(tsc: Collection, kind: str, k: int = 3, seed: int | None = None, length: int | None = None, offset: int = 0, least: int | None = None) -> Iterator[tuple[Collection, Collection]]:
    """(train, test) collections of each split: kind is series, time or window."""
    if kind == "window":
        Checked(tsc).require(finite=False, no_degenerate=False)
        if not overlapping_times(tsc).isEmpty():
            raise CollectionError("series overlap in time")
        rows = window_folds(tsc, length, offset).persist()
        n = rows.agg(F.coalesce(F.max("window") + 1, F.lit(0))).first()[0]
        if not n:
            raise CollectionError("all series are shorter than a window")
        for w in range(n):
            yield _cut(tsc, rows, F.col("window") == w, least)
        return
    rows = (kfold_series(tsc, k, seed) if kind == "series" else kfold_time(tsc, k)).persist()
    for fold in range(k):
        if kind == "series":
            yield tsc.with_df(rows.where(F.col("fold") != fold).drop("fold")), tsc.with_df(rows.where(F.col("fold") == fold).drop("fold"))
        else:
            yield _cut(tsc, rows, F.col("fold") == fold, least)
