"""Gram matrices of row sets: the one big reduction behind every linear model.

`sums` is the exact form for few columns: one aggregation of products, partial on each task. `matrix` is the form for many:
tasks add up their own block in matrix products and the blocks, one a task, are summed entry by entry.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sums(df: DataFrame, left: Sequence[str], right: Sequence[str], weight: Column | None = None, prefix: str = "g", digits: int | None = None) -> DataFrame:
    """One row: n and <prefix>_<r>_<c> = sum of left_r * right_c."""
    one = F.lit(1.0) if weight is None else weight
    cells = [F.sum(F.col(a) * F.col(b) * one if weight is not None else F.col(a) * F.col(b)).alias(f"{prefix}_{r}_{c}") for r, a in enumerate(left) for c, b in enumerate(right)]
    out = df.agg(F.count(F.lit(1)).alias("n"), *cells)
    return out if digits is None else out.select("n", *(F.round(c, digits).alias(c) for c in out.columns[1:]))


def matrix(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None, weight: str | None = None) -> tuple[np.ndarray, int]:
    """(sum over rows of left' right, rows). Columns are doubles; the result has len(left) * len(right) entries."""
    left = list(left)
    names = left + (list(right) if right is not None else [])
    l = len(left)

    def run(batches):
        total, n = None, 0
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]) if batch.num_rows else np.zeros((0, len(names)))
            a, b = x[:, :l], (x[:, l:] if right is not None else x[:, :l])
            if weight is not None:
                a = a * batch.column(len(names)).to_numpy()[:, None]
            total = a.T @ b if total is None else total + a.T @ b
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(total.size), -1)), pa.array(np.append(total.ravel(), float(n)))], names=["at", "v"])

    chosen = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)] + ([F.col(weight).cast("double").alias("w")] if weight else [])
    got = df.select(*chosen).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(l * (len(names) - l if right is not None else l))
    found = dict(zip(got["at"].to_pylist(), got["v"].to_pylist(), strict=True))
    n = int(found.pop(-1, 0))
    for at, v in found.items():
        out[at] = v
    return out.reshape(l, -1), n


def matrices(df: DataFrame, columns: Sequence[str], by: str) -> dict[int, tuple[np.ndarray, int]]:
    """matrix() for each value of the integer column `by` (few: tasks hold a matrix for each), in one pass."""
    d = len(columns)

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column(d).to_numpy(zero_copy_only=False)
            x = np.column_stack([*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)), np.ones(batch.num_rows)])
            for key in np.unique(of).tolist():
                part = x[of == key]
                found[key] = found.get(key, 0.0) + part.T @ part
        for key, total in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, key, np.int64)), pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["key", "at", "v"])

    chosen = df.where(F.col(by).isNotNull()).select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)), F.col(by).cast("long").alias("by"))
    got = chosen.mapInArrow(run, "key long, at long, v double").groupBy("key", "at").agg(F.sum("v").alias("v")).toArrow()
    out: dict[int, np.ndarray] = {}
    for key, at, v in zip(*(got[c].to_pylist() for c in ("key", "at", "v")), strict=True):
        out.setdefault(key, np.zeros((d + 1) ** 2))[at] = v
    return {key: (m.reshape(d + 1, d + 1)[:d, :d], round(m[-1])) for key, m in out.items()}


def kronecker(df: DataFrame, states: Sequence[str], controls: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds a column for each control times state: u0*x0, u0*x1, ..., u1*x0, ..."""
    names = {f"{u}*{x}": F.col(u) * F.col(x) for u in controls for x in states}
    return df.select("*", *(c.alias(n) for n, c in names.items())), list(names)
