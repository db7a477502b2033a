"""Distances between point clouds as edge lists: (i, j, d), i the query, j the reference.

A point cloud is a DataFrame of point_id and x (array<double>). A metric has no key to hash on, so a plain join compares
all pairs. Four plans, chosen by what is asked:

* full: every pair, as a Column expression; for small clouds and exact comparison with SQL.
* grid: for a cut-off in few dimensions, an equi-join on grid cells as wide as the cut-off and their neighbours; nothing
  is broadcast, points of equal coordinates meet others once, and the work follows the number of near pairs.
* blocks: the references are cut into blocks of bounded size; each meets all queries in matrix products, in Arrow
  batches, and only edges within the cut-off, or each query's k nearest of the block, leave the task.
* cells: pivot cells and the triangle inequality (see voronoi); for a cut-off or k nearest in any number of dimensions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.vectors import METRICS

EDGES = "i long, j long, d double"


def _sides(x: DataFrame, y: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    y = x if y is None else y
    return y.select(F.col("point_id").alias("i"), F.col("x").alias("xi")), x.select(F.col("point_id").alias("j"), F.col("x").alias("xj"))


def bound(metric: str, cut_off: float) -> float:
    """The largest distance kept; cut-offs are in euclidean units, for squared distances too."""
    return cut_off * cut_off if metric == "sqeuclidean" else cut_off


def full(x: DataFrame, y: DataFrame | None = None, metric: str = "euclidean", cut_off: float | None = None) -> DataFrame:
    """All pairs, or those within the cut-off (included). For clouds of some thousand points."""
    left, right = _sides(x, y)
    edges = left.crossJoin(right).select("i", "j", METRICS[metric](F.col("xi"), F.col("xj")).alias("d"))
    return edges if cut_off is None else edges.where(F.col("d") <= bound(metric, cut_off))


def packed(x: DataFrame, rows: int = 256) -> DataFrame:
    """x and ids: points of equal coordinates as one row, or as rows of up to `rows` ids."""
    place = F.row_number().over(Window.partitionBy("x").orderBy("point_id")) - 1
    return x.select("point_id", "x", F.floor(place / F.lit(rows)).alias("_n")).groupBy("x", "_n").agg(F.collect_list("point_id").alias("ids")).select("x", "ids")


def grid(x: DataFrame, y: DataFrame | None = None, metric: str = "euclidean", cut_off: float = 1.0, dimensions: int = 2, finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs within the cut-off: cells of the first `dimensions` components as wide as the cut-off; each query looks into the
    3**dimensions cells around its own. Exact for metrics that are never below a component's difference (all but cosine).

    Points of equal coordinates meet others once, and their pairs are spread out from lists of ids afterwards: only that follows
    the number of pairs. finish: of a distance, what goes on as d; worked out before, too."""
    if metric == "cosine":
        raise ValueError("cells don't bound cosine distances")
    references = packed(x)
    left, right = (t.select(F.col("ids").alias(f"{k}s"), F.col("x").alias(f"x{k}")) for t, k in ((references if y is None else packed(y), "i"), (references, "j")))
    cell = lambda c, k: F.floor(F.element_at(c, k + 1) / F.lit(float(cut_off))).cast("long")
    for k in range(dimensions):
        own = cell(F.col("xi"), k)
        left = left.withColumn(f"c{k}", F.explode(F.array(own - 1, own, own + 1)))
        right = right.withColumn(f"c{k}", cell(F.col("xj"), k))
    # Sorted and merged: a compressed table of millions of points would look small enough to go whole through the driver.
    pairs = left.join(right.hint("merge"), [f"c{k}" for k in range(dimensions)])
    near = pairs.select("is", "js", METRICS[metric](F.col("xi"), F.col("xj")).alias("d")).where(F.col("d") <= bound(metric, cut_off))
    if finish is not None:
        near = near.select("is", "js", finish(F.col("d")).alias("d"))
    return near.select(F.explode("is").alias("i"), "js", "d").select("i", F.explode("js").alias("j"), "d")


def _matrix(vectors) -> np.ndarray:
    return np.array(vectors, dtype=float).reshape(len(vectors), -1)


def pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of a from all rows of b. Differences are formed component by component, so equal points are at exactly 0."""
    if metric in ("euclidean", "sqeuclidean", "cityblock", "chebyshev"):
        out = np.zeros((len(a), len(b)))
        for k in range(a.shape[1]):
            gap = a[:, k, None] - b[None, :, k]
            if metric == "cityblock":
                out += np.abs(gap)
            elif metric == "chebyshev":
                np.maximum(out, np.abs(gap), out=out)
            else:
                out += gap * gap
        return np.sqrt(out) if metric == "euclidean" else out
    if metric == "cosine":
        norm = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        return 1 - np.divide(a @ b.T, norm, out=np.full(norm.shape, np.nan), where=norm > 0)
    raise ValueError(f"metric {metric!r}")


def near_pairs(a: np.ndarray, b: np.ndarray, metric: str, limit: float | None = None, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and of b with their distance, as pairwise gives it: all within the limit, and at least each a's k nearest with their ties.

    Squared distances by a matrix product, with a bound of their rounding, leave few pairs whose differences are formed."""
    squares = metric in ("euclidean", "sqeuclidean") and a.shape[1] >= 4 and np.isfinite(a).all() and np.isfinite(b).all()
    if squares and (limit is not None or (k is not None and k < len(b))):
        of_a, of_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
        d = of_a[:, None] + of_b[None] - 2 * (a @ b.T)
        slack = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (of_a + of_b.max())[:, None]
        top = np.full((len(a), 1), np.inf) if limit is None else (limit * limit if metric == "euclidean" else limit) + slack
        if k is not None and k < len(b):
            top = np.minimum(top, np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 2 * slack)
        q, r = np.nonzero(d <= top)
        found = np.zeros(len(q))
        for c in range(a.shape[1]):
            gap = a[q, c] - b[r, c]
            found += gap * gap
        found = np.sqrt(found) if metric == "euclidean" else found
    else:
        d = pairwise(a, b, metric)
        if k is not None and k < len(b):
            q, r = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        else:
            q, r = np.nonzero(np.ones_like(d, bool))
        found = d[q, r]
    if limit is not None:
        good = found <= limit
        q, r, found = q[good], r[good], found[good]
    return q, r, found


def blocks(x: DataFrame, y: DataFrame | None = None, metric: str = "euclidean", cut_off: float | None = None, k: int | None = None, rows: int = 2048) -> DataFrame:
    """Pairs within the cut-off, or each query's k nearest, by blocks of points: groups of blocks of about `rows` meet in tasks that read both
    in the shared folder; of a query's neighbours only the k best of each group go on."""
    from tideline.operators.blocked import Blocks, neighbours

    references = Blocks.of(x, rows)
    queries = references if y is None else Blocks.of(y, rows)
    out = neighbours(queries, references, metric, None if cut_off is None else bound(metric, cut_off), k).select("i", "j", "d")
    return out if k is None else nearest(out, k)


def near_and_nearest(x: DataFrame, y: DataFrame | None, metric: str, cut_off: float, kmin: int, rows: int = 2048) -> DataFrame:
    """Pairs within the cut-off, and of each query its kmin nearest in any case, within one cloud mirrored: by blocks, in one pass. What is
    within the cut-off isn't shuffled."""
    from tideline.operators.blocked import Blocks, neighbours
    from tideline.plans.session import written

    references = Blocks.of(x, rows)
    limit = bound(metric, cut_off)
    found = written(neighbours(references if y is None else Blocks.of(y, rows), references, metric, limit, kmin, both=True), "neighbours")
    far = nearest(found.where("best").select("i", "j", "d"), kmin).where(F.col("d") > limit)
    if y is None:
        far = far.unionByName(far.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).distinct()
    return found.where("NOT best").select("i", "j", "d").unionByName(far)


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest references, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return edges.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def at_least(x: DataFrame, kmin: int, edges: DataFrame, metric: str = "euclidean", y: DataFrame | None = None, plan: str = "full") -> DataFrame:
    """Edges such that each query has its kmin nearest among them, too; within one cloud mirrored."""
    near = distances(x, y, metric, k=kmin, plan=plan)
    if y is None:
        near = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return edges.unionByName(near).groupBy("i", "j").agg(F.min("d").alias("d"))


def distances(x: DataFrame, y: DataFrame | None = None, metric: str = "euclidean", cut_off: float | None = None, k: int | None = None, kmin: int = 0, plan: str = "auto", small: int = 2000, dimensions: int | None = None) -> DataFrame:
    """Edge list by the plan that suits the sizes (auto), or by the one named."""
    from tideline.operators.voronoi import METRIC, near

    if plan == "auto":
        if cut_off is not None and k is None and dimensions is not None and dimensions <= 3 and metric != "cosine":
            plan = "grid"
        elif x.count() * (x if y is None else y).count() <= small * small:
            plan = "full"
        else:
            plan = "cells" if metric in METRIC and (cut_off is not None or k is not None) else "blocks"
    if plan == "blocks" and kmin and cut_off is not None and k is None:
        return near_and_nearest(x, y, metric, cut_off, kmin)
    if plan == "grid":
        edges = grid(x, y, metric, cut_off, dimensions or 2)
    elif plan == "cells":
        edges = near(x, y, metric, cut_off, k).edges
    elif plan == "blocks":
        edges = blocks(x, y, metric, cut_off, k)
    else:
        edges = full(x, y, metric, cut_off)
        edges = edges if k is None else nearest(edges, k)
    return at_least(x, kmin, edges, metric, y, plan if plan in ("full", "cells") else "blocks") if kmin else edges
