"""Exact top-k search by distributed histogram selection.

All queries are scored against all rows, in blocks. Rounds of global histograms (one row a query and bin, summed over
all tasks) narrow each query's range until the k-th highest score is one number; then one pass keeps what is above it,
and of the ties at it the smallest ids that are still needed. No task holds more than a few ties a query, and a
query's rows never meet before they are at most k from each task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tideline.llm.common import materialize

EXACT = 2.0**53


def quantize(batch: pa.RecordBatch, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each vector length in a batch of (id, array): floor(scale * x). Null ids, null vectors and ones with
    a null, NaN or infinite component are left out."""
    ids, lists = batch.column(0), batch.column(1)
    keep = np.array(ids.is_valid()) & np.array(lists.is_valid())
    out: dict[int, list] = {}
    flat, offsets = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64), lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    keys = ids.fill_null(0).to_numpy()
    for d in np.unique(lengths[keep]):
        rows = np.flatnonzero(keep & (lengths == d))
        x = flat[offsets[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))
        good = np.isfinite(x).all(axis=1)
        out[int(d)] = (keys[rows][good], floored(x[good], scale))
    return [(i, x) for i, x in out.values() if len(i)]


def floored(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); as Python integers where that would be beyond what a double holds."""
    if np.abs(x).max(initial=0) < 2.0**1000 / max(abs(scale), 1):
        return np.floor(x * scale)
    by = Fraction(scale)
    return np.frompyfunc(lambda v: floor(Fraction(v) * by), 1, 1)(x)


def norm(x: np.ndarray) -> float:
    """The greatest norm of the rows; infinite where a double can't hold it."""
    if x.dtype == object:
        return float("inf")
    with np.errstate(over="ignore"):
        return float(np.sqrt((x * x).sum(axis=1)).max(initial=0))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact; beyond 64 bits they stay at the largest or smallest 64-bit number."""
    huge = a.dtype == object or b.dtype == object
    most = float("inf") if huge else a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**23:
        return a.astype(np.float32) @ b.T.astype(np.float32)
    if most < EXACT:
        return a @ b.T
    if not a.shape[1]:
        return np.zeros((len(a), len(b)))
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1)


class Block:
    """A block of queries with the range in which each k-th score lies: low <= score < low + width * bins."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.place = {}
        for q, i in enumerate(ids.tolist()):
            self.place.setdefault(i, []).append(q)

    def own(self, ids: np.ndarray) -> tuple[list[int], list[int]]:
        """Pairs (row, query) that are one and the same id."""
        hits = [(c, q) for c in np.flatnonzero(np.isin(ids, self.ids)) for q in self.place[int(ids[c])]]
        return [c for c, _ in hits], [q for _, q in hits]


def score_blocks(batches: Iterable[pa.RecordBatch], block: Block, scale: float, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores against all the block's queries) for rows of the same vector length."""
    for batch in batches:
        for ids, x in quantize(batch, scale):
            if x.shape[1] == block.x.shape[1]:
                for at in range(0, len(ids), rows):
                    yield ids[at : at + rows], inner(x[at : at + rows], block.x)


def histograms(data: DataFrame, block: Block, low: np.ndarray, span: int, width: int, bins: int, scale: float) -> np.ndarray:
    """How many scores of low <= score < low + span fall in each bin of `width`, for each query of the block, over all rows."""

    def run(batches):
        m = len(block.ids)
        total = np.zeros(m * bins, np.int64)
        base = np.arange(m, dtype=np.int64) * bins
        exact = [int(v) for v in low]
        for ids, s in score_blocks(batches, block, scale):
            if s.dtype == object:
                at = np.array([[(int(v) - l) // width if 0 <= int(v) - l < span else -1 for v, l in zip(row, exact, strict=True)] for row in s], np.int64).reshape(s.shape)
            else:
                kind = np.int32 if s.dtype == np.float32 and width < 1 << 24 and np.abs(low).max() < 1 << 24 else np.int64
                above_low = s.astype(kind) - low.astype(kind)
                at = np.where((above_low >= 0) & (above_low < span), above_low // kind(width), kind(-1))
            inside = at >= 0
            total += np.bincount((at + base)[inside], minlength=m * bins)
            for c, q in zip(*block.own(ids), strict=True):
                if inside[c, q]:
                    total[base[q] + at[c, q]] -= 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["at", "n"])

    got = data.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(block.ids) * bins, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(len(block.ids), bins)


def kth_scores(data: DataFrame, block: Block, bound: int, bins: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k-th highest score, and how many scores are above it. Fewer than k rows: a score below all."""
    m = len(block.ids)
    span = 2 * bound + 1
    width = -(-span // bins)
    low, above = np.array([-bound] * m, dtype=object), np.zeros(m, np.int64)
    short = np.zeros(m, bool)
    first = True
    while True:
        as_int = low.astype(np.int64) if bound < 1 << 62 else low
        counts = histograms(data, block, as_int, span, width, bins, scale)
        down = above[:, None] + np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # scores in a bin or above it
        if first:
            short, first = down[:, 0] < block.k, False
        at = np.maximum((down >= block.k).sum(axis=1) - 1, 0)
        above = np.where(short, 0, down[np.arange(m), at] - counts[np.arange(m), at])
        low = np.array([v + int(a) * width for v, a in zip(low, at, strict=True)], dtype=object)
        if width == 1:
            return np.array([-(1 << 63) if s else v for s, v in zip(short, low, strict=True)], dtype=object), above
        span, width = width, -(-width // bins)


def keep_best(data: DataFrame, block: Block, kth: np.ndarray, above: np.ndarray, scale: float) -> DataFrame:
    """Rows above each query's k-th score, and from each task the ties with the smallest ids, as many as are needed."""
    floor = kth.astype(np.int64)
    need = np.where(floor == -(1 << 63), 1 << 62, block.k - above)

    def trimmed(q, i, s):
        tie = s == floor[q]
        order = np.lexsort((i, q))
        q, i, s, tie = q[order], i[order], s[order], tie[order]
        rank = np.cumsum(tie) - tie
        begin = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        rank -= np.maximum.accumulate(np.where(begin, rank, 0))
        good = ~tie | (rank < need[q])
        return q[good], i[good], s[good]

    def run(batches):
        held, size = [(np.zeros(0, np.int64),) * 3], 0
        for ids, s in score_blocks(batches, block, scale):
            s = s.astype(np.int64)
            hit = s >= floor
            hit[block.own(ids)] = False
            c, q = np.nonzero(hit)
            held.append((q, ids[c], s[c, q]))
            size += len(c)
            if size > 200_000:
                held = [trimmed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = 0
        q, i, s = trimmed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(block.ids[q]), pa.array(i), pa.array(s)], names=["q", "query_id", "vec_id", "score"])

    return data.mapInArrow(run, "q long, query_id long, vec_id long, score long")


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding", block_rows: int = 4096, bins: int = 256) -> DataFrame:
    """For each row whose key is divisible by `every` the k other rows with the highest integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; a query with fewer candidates gets all.
    Null keys, null vectors and ones with null or non-finite components take no part; vectors are compared with those of their own length.
    Rows that repeat a key are all its own: none is a candidate for another, and each is a query. An empty table gives no rows.
    Queries are worked on in blocks of about block_rows, which bounds what is broadcast and what each histogram holds.
    """
    data = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    asked = data.where(F.col("k") % every == 0)
    blocks = max(1, -(-asked.count() // block_rows))

    def longest_of(batches):
        most = 0.0
        for batch in batches:
            for _, x in quantize(batch, scale):
                most = max(most, norm(x))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["n"])

    longest = data.mapInArrow(longest_of, "n double").agg(F.max("n")).first()[0] or 0.0
    found = []
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).toArrow()
        for ids, x in (pair for batch in got.to_batches() for pair in quantize(batch, scale)):
            own = norm(x)
            bound = min(own * longest + 1 if own and longest else 1, 2.0**63)
            block = Block(ids, x, k)
            kth, above = kth_scores(data, block, int(bound), bins, scale)
            best = keep_best(data, block, kth, above, scale).withColumn("q", F.col("q") + F.lit(len(found) << 32))
            found.append(materialize(best, "topk") if blocks > 1 else best)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast(LongType()).alias("score"))
