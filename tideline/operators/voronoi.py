"""Exact range and k-nearest-neighbour joins in a metric space, of any number of dimensions, by pivot cells.

A bounded sample of references are pivots. A query belongs to the cell of its nearest pivot; a cell's queries are a group. A
query whose neighbours lie within b of it needs only references within d(query, pivot) + b of its group's pivot (triangle
inequality), so a reference goes to the groups in whose reach it is, and to no others. For k nearest neighbours b comes from
a first join of each query with the references of its own cell.

Groups and their references are dealt into units of bounded size, so a hot cell is many tasks' work; each query keeps its k best
of each unit at most. What is held by all tasks is the pivots and two numbers a cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.distance import EDGES, blocks, bound, near_pairs, nearest, pairwise
from tideline.plans.session import written

#: Metrics by the true metric that orders points alike.
METRIC = {"euclidean": "euclidean", "sqeuclidean": "euclidean", "cityblock": "cityblock", "chebyshev": "chebyshev"}


#: Copies of points that a join by cells may send in any case.
MANY = 1 << 16


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


@dataclass
class Cells:
    pivots: np.ndarray
    metric: str

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell, and its distances from all pivots."""
        d = pairwise(x, self.pivots, self.metric)
        return d.argmin(axis=1), d


@dataclass
class Neighbours:
    """edges: i (query), j (reference), d. share: of all pairs of a query and a reference, those that were compared (0 to 1)."""

    edges: DataFrame
    share: float


def groups_of(cells: Cells, queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's number of queries, and how far from its pivot they reach. queries: i, x, b (null: without bound)."""
    n = len(cells.pivots)

    def run(batches):
        count, reach = np.zeros(n, np.int64), np.full(n, -np.inf)
        for batch in batches:
            if batch.num_rows:
                cell, d = cells.placed(matrix_of(batch.column(0)))
                np.add.at(count, cell, 1)
                np.maximum.at(reach, cell, d[np.arange(len(d)), cell] + batch.column(1).fill_null(math.inf).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(count), pa.array(reach)], names=["cell", "n", "reach"])

    got = queries.select("x", "b").mapInArrow(run, "cell long, n long, reach double").groupBy("cell").agg(F.sum("n"), F.max("reach")).toArrow().sort_by("cell")
    return got[1].to_numpy(), got[2].to_numpy() * (1 + 1e-9) + 1e-12


def joined(cells: Cells, references: DataFrame, queries: DataFrame, metric: str, count: np.ndarray, reach: np.ndarray | None, k: int | None, limit: float | None, rows: int, most: int | None = None) -> tuple[DataFrame | None, int]:
    """Edges of queries (i, x) with the references (j, x) in reach of their group, or, without a reach, in their own cell; and the number of
    pairs that are compared. None, where cells exclude so little that more than `most` copies of points would be sent."""
    n = len(cells.pivots)

    def needed(x):
        cell, d = cells.placed(x)
        hit = cell[:, None] == np.arange(n) if reach is None else d <= reach
        return np.nonzero(hit & (count > 0))

    def sizes(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(needed(matrix_of(batch.column(0)))[1], minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["cell", "n"])

    met = references.select("x").mapInArrow(sizes, "cell long, n long").groupBy("cell").agg(F.sum("n")).toArrow().sort_by("cell")[1].to_numpy()
    of_queries, of_references = np.maximum(1, -(-count // rows)), np.maximum(1, -(-met // rows))
    copies = int((met * of_queries * (count > 0)).sum() + (count * of_references).sum())
    if most is not None and copies > most:
        return None, 0

    def sent(batch, at, cell, own, other, queries_side):
        """Rows for units: a place on the own side by the row's number, a copy for each place on the other side."""
        place = batch.column(0).to_numpy()[at] % 4294967291 * 2654435761 % 4294967291 % own[cell]
        times = other[cell]
        which = np.repeat(np.arange(len(at)), times)
        copy = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        a, b = (place[which], copy) if queries_side else (copy, place[which])
        for s in range(0, len(which), 1 << 14):
            part = which[s : s + (1 << 14)]
            columns = batch.take(pa.array(at[part])).columns
            yield pa.RecordBatch.from_arrays([pa.array(cell[part]), pa.array(a[s : s + (1 << 14)]), pa.array(b[s : s + (1 << 14)]), *columns], names=["g", "uq", "ur", "id", "x"])

    def of_reference(batches):
        for batch in batches:
            if batch.num_rows:
                at, cell = needed(matrix_of(batch.column(1)))
                yield from sent(batch, at, cell, of_references, of_queries, False)

    def of_query(batches):
        for batch in batches:
            if batch.num_rows:
                cell, _ = cells.placed(matrix_of(batch.column(1)))
                yield from sent(batch, np.arange(len(cell)), cell, of_queries, of_references, True)

    units = "g long, uq long, ur long, id long, x array<double>"
    left, right = queries.select("i", "x").mapInArrow(of_query, units), references.select("j", "x").mapInArrow(of_reference, units)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            i, j, a, b = left["id"].to_numpy(), right["id"].to_numpy(), matrix_of(left["x"]), matrix_of(right["x"])
            for at in range(0, len(a), 256):
                q, r, d = near_pairs(a[at : at + 256], b, metric, limit, k)  # ties at the end are sorted out afterwards
                for held, made in zip(out, (i[at + q], j[r], d), strict=True):
                    held.append(made)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["i", "j", "d"])

    made = left.groupBy("g", "uq", "ur").cogroup(right.groupBy("g", "uq", "ur")).applyInArrow(meet, EDGES)
    return made, int((count * met).sum())


def near(x: DataFrame, y: DataFrame | None = None, metric: str = "euclidean", cut_off: float | None = None, k: int | None = None, pivots: int = 256, rows: int = 4096, seed: int = 5) -> Neighbours:
    """Neighbours of the queries y (x itself if None) among the references x: those within the cut-off (included; in euclidean units for
    squared distances, too), the k nearest (ties to the smaller number), or the k nearest of those within the cut-off.

    pivots: the most that are drawn; a cloud of n points gets about half the root of n. Empty clouds give no edges."""
    if metric not in METRIC:
        raise ValueError(f"{metric!r} isn't a metric with a triangle inequality")
    if cut_off is None and k is None:
        raise ValueError("a cut-off or a number of neighbours is needed")
    references, n = x.select(F.col("point_id").alias("j"), "x"), x.count()
    queries = (x if y is None else y).select(F.col("point_id").alias("i"), "x")
    asked = n if y is None else y.count()
    if not n or not asked:
        return Neighbours(x.sparkSession.createDataFrame([], EDGES), 0.0)
    drawn = x.select("point_id", "x").orderBy(F.xxhash64(F.lit(seed), "point_id"), "point_id").limit(max(1, min(pivots, math.isqrt(n) // 2))).collect()
    cells = Cells(np.array([r["x"] for r in drawn], float).reshape(len(drawn), -1), METRIC[metric])
    limit = None if cut_off is None else bound(metric, cut_off)
    queries, compared = queries.withColumn("b", F.lit(cut_off).cast("double")), 0
    if k is not None:
        count, _ = groups_of(cells, queries)
        edges, compared = joined(cells, references, queries, metric, count, None, k, limit, rows)
        far = nearest(edges, k).groupBy(F.col("i").alias("_i")).agg(F.count(F.lit(1)).alias("_n"), F.max("d").alias("_d"))
        worst = F.when(F.col("_n") >= k, F.sqrt("_d") if metric == "sqeuclidean" else F.col("_d"))
        queries = written(queries.join(far, F.col("i") == F.col("_i"), "left").select("i", "x", F.least("b", worst).alias("b")), "bounded-queries")
    count, reach = groups_of(cells, queries)
    edges, more = joined(cells, references, queries, metric, count, reach, k, limit, rows, max(MANY, 4 * (n + asked)))
    if edges is None:
        return Neighbours(blocks(x, y, metric, cut_off, k), 1.0)
    edges = edges if k is None else nearest(edges, k)
    return Neighbours(edges, (compared + more) / (asked * n))
