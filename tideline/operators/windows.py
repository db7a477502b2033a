"""Operators over neighbouring samples: shift pairs, delay embedding, finite differences, moving averages.

All are window expressions over (partition by id order by time); several of them in one select share one exchange and one sort.

A series that is too long for one task is cut: with `piece`, windows run over pieces of that many samples, each with a halo of as
many of its neighbours' samples as the operator reaches back and ahead. Results are the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.functions.linalg import fd_stencil
from tideline.functions.vectors import linear
from tideline.operators.collection import Collection, CollectionError, tasks
from tideline.plans.session import written


@dataclass(frozen=True)
class Frame:
    """Rows to run windows over: df, the window, a row's place in its series (from 0) and the series' length, and which rows count."""

    df: DataFrame
    by_time: WindowSpec
    at: Column
    total: Column
    own: Column


def framed(tsc: Collection, back: int, ahead: int, piece: int | None = None) -> Frame:
    """The collection as it is, or (piece) in pieces of so many samples with halos. Places in a series come from ranges of (id, time), so
    no task sees a whole series."""
    if piece is None:
        w = tsc.by_time
        return Frame(tsc.df, w, F.row_number().over(w) - 1, F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(True))
    if piece < max(back, ahead, 1):
        raise CollectionError(f"a piece has {max(back, ahead, 1)} samples at least")
    n = tasks(tsc.df)
    placed = placed_in_series(tsc, n)
    number, inside = F.floor(F.col("_at") / F.lit(piece)), F.col("_at") % piece
    copy = lambda n, own: F.struct(n.alias("piece"), F.lit(own).alias("own"))
    copies = F.array_compact(F.array(copy(number, True), F.when(inside >= piece - back, copy(number + 1, False)), F.when((inside < ahead) & (number > 0), copy(number - 1, False))))
    dealt = placed.withColumn("_c", F.explode(copies)).withColumn("_piece", F.col("_c.piece")).withColumn("_own", F.col("_c.own")).drop("_c")
    dealt = dealt.repartition(n, tsc.id, "_piece")
    return Frame(dealt, Window.partitionBy(tsc.id, "_piece").orderBy(tsc.time), F.col("_at"), F.col("_total"), F.col("_own"))


def placed_in_series(tsc: Collection, n: int) -> DataFrame:
    """The rows with their place in their series (_at, from 0) and its length (_total).

    Rows are dealt by n ranges of (id, time) and written; only the counts of each range's series meet, so that a long series stays apart."""
    dealt = written(tsc.df.repartitionByRange(n, tsc.id, tsc.time).withColumn("_range", F.spark_partition_id()), "ranges")
    counts, series = dealt.groupBy(tsc.id, "_range").agg(F.count(F.lit(1)).alias("_k")), Window.partitionBy(tsc.id)
    before = F.coalesce(F.sum("_k").over(series.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select(tsc.id, "_range", before.alias("_base"), F.sum("_k").over(series).alias("_total"))
    placed = dealt.repartition(n, tsc.id, "_range").join(spans, [tsc.id, "_range"])
    inside = F.row_number().over(Window.partitionBy(tsc.id, "_range").orderBy(tsc.time)) - 1
    return placed.withColumn("_at", F.col("_base") + inside).drop("_range", "_base")


def shift_pairs(tsc: Collection, suffix: str = "_next", piece: int | None = None) -> DataFrame:
    """Each sample with the next one of its series: id, time, features, features + suffix."""
    over = framed(tsc, 0, 1, piece)
    w = over.by_time
    nexts = [F.lead(f).over(w).alias(f"{f}{suffix}") for f in tsc.features]
    marked = over.df.select(tsc.id, tsc.time, *tsc.features, *nexts, F.lead(tsc.time).over(w).isNotNull().alias("_has"), over.own.alias("_mine"))
    return marked.where("_has AND _mine").drop("_has", "_mine")


def delay_indices(delays: int, lag: int = 0, frequency: int = 1) -> list[int]:
    """How many samples back each delay lies."""
    if delays < 1 or lag < 0 or frequency < 1:
        raise CollectionError("delays and frequency are at least 1, lag at least 0")
    if frequency > 1 and delays <= 1:
        raise CollectionError("a frequency needs several delays")
    return [lag + i for i in range(1, delays * frequency + 1, frequency)]


def takens(tsc: Collection, delays: int = 10, lag: int = 0, frequency: int = 1, kappa: float = 0.0, piece: int | None = None) -> Collection:
    """Features with delayed copies `f:d<delay>`; the first rows of a series, which lack some, are left out. kappa > 0 weighs
    the m-th copy by exp(-kappa * m), and the original stays."""
    back = delay_indices(delays, lag, frequency)
    over = framed(tsc, back[-1], 0, piece)
    w, columns, names = over.by_time, [], list(tsc.features)
    for m, d in enumerate(back, 1):
        for f in tsc.features:
            late = F.lag(f, d).over(w)
            columns.append((late * F.lit(math.exp(-kappa * m)) if kappa else late).alias(f"{f}:d{d}"))
            names.append(f"{f}:d{d}")
    marked = over.df.select(tsc.id, tsc.time, *tsc.features, *columns, over.at.alias("_rn"), over.own.alias("_mine"))
    return tsc.with_df(marked.where((F.col("_rn") >= back[-1]) & F.col("_mine")).drop("_rn", "_mine"), names)


def finite_difference(tsc: Collection, delta: float, scheme: str = "center", order: int = 1, accuracy: int = 2, shift_index: bool = False, suffix: str = "", piece: int | None = None) -> Collection:
    """Derivatives of each feature. Rows whose stencil reaches beyond the series are left out; a row's time is the stencil's
    reference, or its last sample with shift_index."""
    offsets, weights = fd_stencil(scheme, order, accuracy)
    move = offsets[-1] if shift_index else 0
    over = framed(tsc, max(0, move - offsets[0]), max(0, offsets[-1] - move), piece)
    w = over.by_time

    def at(column: str, offset: int) -> Column:
        o = offset - move
        return F.lag(column, -o).over(w) if o < 0 else F.lead(column, o).over(w) if o > 0 else F.col(column)

    scale = [c / delta**order for c in weights]
    values = [linear([at(f, o) for o in offsets], scale).alias(f"{f}{suffix}") for f in tsc.features]
    marked = over.df.select(tsc.id, tsc.time, *values, over.at.alias("_rn"), over.total.alias("_n"), over.own.alias("_mine"))
    first, last = max(0, move - offsets[0]), max(0, offsets[-1] - move)
    inside = (F.col("_rn") >= first) & (F.col("_rn") < F.col("_n") - last) & F.col("_mine")
    return tsc.with_df(marked.where(inside).drop("_rn", "_n", "_mine"), [f"{f}{suffix}" for f in tsc.features])


def moving_average(tsc: Collection, window: int = 3, piece: int | None = None) -> Collection:
    """Mean of each feature over the last `window` samples, `f_ma<window>`; rows with fewer, or with a null or NaN in them, are left out."""
    over = framed(tsc, window - 1, 0, piece)
    w = over.by_time
    frame = w.rowsBetween(-(window - 1), 0)
    names = [f"{f}_ma{window}" for f in tsc.features]
    columns = [F.avg(f).over(frame).alias(n) for f, n in zip(tsc.features, names, strict=True)]
    whole = [F.count(F.when(~F.isnan(f), F.col(f))).over(frame).alias(f"_c{i}") for i, f in enumerate(tsc.features)]
    marked = over.df.select(tsc.id, tsc.time, *columns, *whole, over.own.alias("_mine")).where("_mine")
    for i in range(len(tsc.features)):
        marked = marked.where(F.col(f"_c{i}") == window)
    return tsc.with_df(marked.select(tsc.id, tsc.time, *names), names)
