"""Hard-negative mining by a Voronoi-partition distributed kNN join.

Norm-augmented vectors turn inner products into distances: a row x gets one more component sqrt(M^2 - |x|^2) (M: the
greatest norm), an anchor gets 0 there, and |a' - x'|^2 = |a|^2 + M^2 - 2 a.x. A bounded sample of rows are pivots; each
row and each anchor belongs to the cell of its nearest pivot. A cell's anchors are a group; the group's bounds (how far
its anchors lie from the pivot, and how far their neighbours may lie from them) decide by the triangle inequality which
rows it might need, and only those are replicated to it. There anchors and rows meet in an exact local join on integers.

Three joins: anchors with the rows of their own cell, which bounds how far each one's positives can be; anchors with the
rows of their label within those bounds, which gives the positives; anchors with the rows in the ring that the positives'
scores leave for negatives.

Scale. What tasks hold is bounded: pivots, and for each cell and each of `CLASSES` classes of labels a few numbers. A group's
anchors and rows are dealt into units of bounded bytes, each pair of units a task's work of its own, so neither a cell nor
a label has to fit in one task; partial results are at most `count` rows an anchor (or a positive) and unit. How much
is replicated follows the data: in many dimensions bounds can't exclude much, and a group meets what all exact joins meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import forget, materialize

#: Labels are dealt into so many classes where tables by label must stay small.
CLASSES = 64
EXACT, LEAST, MOST = 2.0**53, -(1 << 63), (1 << 63) - 1
ROW = "row long, id long, label long, d int, big boolean, q binary, anchor boolean"


def whole(x: np.ndarray, scale: float) -> tuple[np.ndarray, bool]:
    """floor(scale * x) of finite components, exactly, and whether they are beyond 32 bits (then as Python integers). scale: a power of two."""
    if not len(x) or np.abs(x).max() * scale < 2.0**31 - 1:
        return np.floor(x * scale).astype(np.int64), False
    return np.array([int(v) * int(scale) if abs(v) >= EXACT else int(np.floor(v * scale)) for v in x], dtype=object), True


def packed(q: np.ndarray, big: bool) -> bytes:
    if big:
        return b" ".join(str(v).encode() for v in q)
    return q.astype("<i2" if not len(q) or np.abs(q).max() < 1 << 15 else "<i4").tobytes()


def unpacked(raw: bytes, d: int, big: bool) -> np.ndarray:
    if big:
        return np.array([int(v) for v in raw.split(b" ")], dtype=object)
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * d else "<i4").astype(np.int64)


def prepared(vectors: DataFrame, key: str, vector: str, label: str, every: int, scale: float) -> DataFrame:
    """Rows that take part, quantised, with a number of their own."""

    def run(batches):
        for batch in batches:
            out = []
            for row, i, of, v, anchor in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if i is None or of is None or v is None or None in v:
                    continue
                x = np.asarray(v, dtype=np.float64)
                if np.isfinite(x).all():
                    q, big = whole(x, scale)
                    out.append((row, i, of, len(q), big, packed(q, big), anchor))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_()), strict=True)], names=["row", "id", "label", "d", "big", "q", "anchor"])

    picked = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), vector, (F.col(key) % every == 0).alias("anchor"))
    return materialize(picked.mapInArrow(run, ROW), "vectors")


def matrices(batch: pa.RecordBatch | pa.Table):
    """(row numbers, float64 matrix, or None where components are huge) for each vector length."""
    d, big, q = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("d", "big", "q"))
    d, big = np.array(d, int), np.array(big, bool)
    for size in np.unique(d):
        for huge in (False, True):
            rows = np.flatnonzero((d == size) & (big == huge))
            if len(rows):
                yield rows, np.array([unpacked(q[i], size, huge) for i in rows]).reshape(len(rows), size)


@dataclass
class Cells:
    """Pivots (vectors of any length, as if zeros followed) and the greatest norm. Without pivots all rows are in cell 0, at no known distance."""

    pivots: list[np.ndarray]
    norm2: float

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """From augmented rows (or anchors) to augmented pivots."""
        own = (x * x).sum(axis=1)
        lift = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.norm2 - own, 0))
        out = np.empty((len(x), len(self.pivots)))
        for k, p in enumerate(self.pivots):
            m, p2 = min(len(p), x.shape[1]), float(p @ p)
            raised = np.sqrt(max(self.norm2 - p2, 0))
            out[:, k] = own + p2 - 2 * (x[:, :m] @ p[:m]) + (lift - raised) ** 2
        return np.sqrt(np.maximum(out, 0))

    @property
    def n(self) -> int:
        return max(1, len(self.pivots))

    @property
    def slack(self) -> float:
        """More than rounding can add to a distance or a bound."""
        return 1e-5 * (1 + np.sqrt(self.norm2))

    def placed(self, x: np.ndarray, anchors: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Each row's cell, and its distances from all pivots (None without pivots, or for huge components)."""
        if not self.pivots or x.dtype == object:
            return np.zeros(len(x), int), None
        d = self.distances(x.astype(float), anchors)
        return d.argmin(axis=1), d


def chosen(table: DataFrame, most: int, seed: int = 12) -> Cells:
    """Cells of at most `most` pivots, one for about 64 anchors, drawn by a seeded hash. None where components are huge."""
    norms = F.max("big"), F.count_if("anchor")
    huge, anchors = table.agg(*norms).first()

    def run(batches):
        top = 0.0
        for batch in batches:
            for _, x in matrices(batch):
                top = max(top, float((x.astype(float) ** 2).sum(axis=1).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["n"])

    if huge or not anchors:
        return Cells([], 0.0)
    n = min(most, max(1, anchors // 64))
    got = table.select("row", "d", "big", "q").orderBy(F.xxhash64(F.lit(seed), "row"), "row").limit(n).collect() if n > 1 else []
    norm2 = table.select("d", "big", "q").mapInArrow(run, "n double").agg(F.max("n")).first()[0] or 0.0
    return Cells([unpacked(bytes(r["q"]), r["d"], False).astype(float) for r in got], norm2)


@dataclass
class Ring:
    """For each cell and class: rows are needed whose distance from the pivot is between low and high. shape: (cells, classes)."""

    low: np.ndarray
    high: np.ndarray


def reach(cells: Cells, anchors: DataFrame, classes: int) -> tuple[Ring, np.ndarray]:
    """Bounds of all groups and their numbers of anchors. anchors: rows with `least` and `most`, the scores between which an anchor still
    wants rows (null least: all)."""

    def run(batches):
        low, high, n = np.full((cells.n, classes), np.inf), np.full((cells.n, classes), -np.inf), np.zeros((cells.n, classes), np.int64)
        for batch in batches:
            label, least, most = (batch.column(batch.schema.get_field_index(c)) for c in ("label", "least", "most"))
            of = class_of(label.to_numpy(), classes)
            bottom, top = least.cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False), most.cast(pa.float64()).fill_null(np.inf).to_numpy(zero_copy_only=False)
            for rows, x in matrices(batch):
                cell, d = cells.placed(x, True)
                np.add.at(n, (cell, of[rows]), 1)
                if d is None:
                    low[cell, of[rows]], high[cell, of[rows]] = 0, np.inf
                    continue
                own, from_pivot = (x.astype(float) ** 2).sum(axis=1) + cells.norm2, d[np.arange(len(x)), cell]
                far = np.sqrt(np.maximum(own - 2 * bottom[rows], 0)) + cells.slack
                near = np.sqrt(np.maximum(own - 2 * top[rows], 0)) - cells.slack
                np.maximum.at(high, (cell, of[rows]), from_pivot + far)
                np.minimum.at(low, (cell, of[rows]), np.maximum(near - from_pivot, 0))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (at, low.ravel()[at], high.ravel()[at], n.ravel()[at])], names=["at", "low", "high", "n"])

    got = anchors.mapInArrow(run, "at long, low double, high double, n long").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()
    ring, n = Ring(np.full((cells.n, classes), np.inf), np.full((cells.n, classes), -np.inf)), np.zeros((cells.n, classes), np.int64)
    at = got["at"].to_numpy()
    ring.low.ravel()[at], ring.high.ravel()[at], n.ravel()[at] = got["low"].to_numpy(), got["high"].to_numpy(), got["n"].to_numpy()
    return ring, n


def class_of(label: np.ndarray, classes: int) -> np.ndarray:
    return (label % classes).astype(int)


def needed(cells: Cells, batch: pa.RecordBatch, ring: Ring | None, has: np.ndarray):
    """(rows of the batch, their groups): by the rings, or, without, each row's own cell. has: which groups have anchors."""
    classes = has.shape[1]
    of = class_of(batch.column(batch.schema.get_field_index("label")).to_numpy(), classes)
    for rows, x in matrices(batch):
        cell, d = cells.placed(x, False)
        if ring is None:
            hit = cell[:, None] == np.arange(cells.n)
        elif d is None:
            hit = np.ones((len(rows), cells.n), bool)
        else:
            hit = (d >= ring.low[:, of[rows]].T - cells.slack) & (d <= ring.high[:, of[rows]].T + cells.slack)
        hit &= has[:, of[rows]].T > 0
        i, group = np.nonzero(hit)
        yield rows[i], group * classes + of[rows][i]


def joined(cells: Cells, table: DataFrame, anchors: DataFrame, classes: int, ring: Ring | None, n: np.ndarray, local, schema: str, unit_rows: int = 16384, unit_anchors: int = 1024, unit_bytes: int = 16 << 20) -> DataFrame:
    """local(anchors, rows) of each pair of units of a group's anchors and the rows that it might need."""
    d = table.agg(F.max(F.length("q"))).first()[0] or 1
    unit_rows, unit_anchors = (max(16, min(u, unit_bytes // (8 * d))) for u in (unit_rows, unit_anchors))

    def count(batches):
        total = np.zeros(n.size, np.int64)
        for batch in batches:
            for _, group in needed(cells, batch, ring, n):
                total += np.bincount(group, minlength=n.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    sizes = np.zeros(n.size, np.int64)
    got = table.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sizes[got["at"].to_numpy()] = got["n"].to_numpy()
    of_rows, of_anchors = np.maximum(1, -(-sizes // unit_rows)), np.maximum(1, -(-n.ravel() // unit_anchors))

    def sent(batch, rows, group, own, other, mine_first):
        """Rows for units: a place in the own side by the row's number, one copy for each place on the other side."""
        place = batch.column(batch.schema.get_field_index("row")).to_numpy()[rows] * 2654435761 % 4294967291 % own[group]
        times = other[group]
        at = np.repeat(np.arange(len(rows)), times)
        copy = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        a, b = (place[at], copy) if mine_first else (copy, place[at])
        picked = batch.take(pa.array(rows[at]))
        units = [pa.array(group[at]), pa.array(a), pa.array(b)]
        return pa.RecordBatch.from_arrays(units + picked.columns, names=["g", "ua", "ur", *batch.schema.names])

    def of_table(batches):
        for whole_ in batches:
            for s in range(0, whole_.num_rows, 256):
                batch = whole_.slice(s, 256)
                for rows, group in needed(cells, batch, ring, n):
                    yield sent(batch, rows, group, of_rows, of_anchors, False)

    def of_asked(batches):
        for batch in batches:
            label = class_of(batch.column(batch.schema.get_field_index("label")).to_numpy(), classes)
            for rows, x in matrices(batch):
                cell, _ = cells.placed(x, True)
                yield sent(batch, rows, cell * classes + label[rows], of_anchors, of_rows, True)

    def with_units(df, run):
        return df.mapInArrow(run, "g long, ua long, ur long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))

    left, right = with_units(anchors, of_asked), with_units(table.select("row", "id", "label", "d", "big", "q"), of_table)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            right = right.combine_chunks().sort_by("id")
            for mine, a in matrices(left):
                for others, x in matrices(right):
                    if a.shape[1] == x.shape[1]:
                        rows.append(local(left, mine, a, right, others, x))
        return pa.concat_tables(rows) if rows else table_of(schema, [])

    units = ["g", "ua", "ur"]
    return left.groupBy(*units).cogroup(right.groupBy(*units)).applyInArrow(meet, schema)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows as 64-bit integers; those beyond stay at the largest or smallest one."""
    if a.dtype == object or b.dtype == object:
        return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64) if a.shape[1] else np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return inner(a.astype(object), b)


def of(table: pa.Table, name: str, rows: np.ndarray) -> np.ndarray:
    return table[name].to_numpy()[rows]


BEST = "row long, other long, score long"
BANDS = "row long, anchor_id long, place int, positive_id long, positive_score long, other long, score long"


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in schema.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


def scored(left: pa.Table, mine: np.ndarray, a: np.ndarray, right: pa.Table, others: np.ndarray, x: np.ndarray, cells: int = 1 << 20):
    """(place in left, scores with all rows, rows' labels equal the anchor's, ids that aren't the anchor's) for each anchor; about `cells` scores at a time."""
    ids, label, their_ids, their_label = of(left, "id", mine), of(left, "label", mine), of(right, "id", others), of(right, "label", others)
    step = max(1, cells // max(1, len(x)))
    for at in range(0, len(a), step):
        s = inner(a[at : at + step], x)
        for i in range(len(s)):
            yield mine[at + i], s[i], their_label == label[at + i], their_ids != ids[at + i]


def first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores in order, ties to smaller ids."""
    rows = np.arange(len(score))
    if len(score) > k:
        rows = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return rows[np.lexsort((ids[rows], ~score[rows]))[:k]]


def best_of_label(k: int):
    """An anchor's k best rows of its own label in a unit."""

    def local(left, mine, a, right, others, x):
        ids, row, out = of(right, "id", others), left["row"].to_numpy(), []
        for place, s, same, other in scored(left, mine, a, right, others, x):
            at = np.flatnonzero(same & other)
            at = at[first(ids[at], s[at], k)]
            out += zip([row[place]] * len(at), ids[at], s[at], strict=True)
        return table_of(BEST, out)

    return local


def best_in_bands(k: int, percent: int):
    """For each of an anchor's positives the k best rows of other labels in a unit that score no more than it and no less than `percent` of it."""

    def local(left, mine, a, right, others, x):
        ids, row, out = of(right, "id", others), left["row"].to_numpy(), []
        anchor_ids, positives = left["id"].to_numpy(), left["positives"].to_pylist()
        for place, s, same, other in scored(left, mine, a, right, others, x):
            bands = [(p, min(max(-(-percent * p["score"] // 100), LEAST), MOST)) for p in positives[place]]
            floor = min(low for _, low in bands)
            at = np.flatnonzero(~same & other & (s >= floor))
            at = at[np.lexsort((ids[at], ~s[at]))]
            for p, low in bands:
                hit = at[(s[at] <= p["score"]) & (s[at] >= low)][:k]
                out += [(row[place], anchor_ids[place], p["place"], p["other"], p["score"], i, v) for i, v in zip(ids[hit], s[hit], strict=True)]
        return table_of(BANDS, out)

    return local


def ranked(df: DataFrame, by: list[str], k: int, out: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other"))
    return df.withColumn(out, rank).where(F.col(out) <= k)


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, scale: float = 256.0, positives: int = 5, count: int = 5, percent: int = 80, pivots: int = 256, unit_rows: int = 16384, unit_anchors: int = 1024) -> DataFrame:
    """Hard negatives of each row whose key is divisible by `every`: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the inner product of floor(scale * x) with the anchor's; an anchor's positives are its first `positives` other rows of
    its label, and a positive's negatives the first `count` rows of other labels that score no more than the positive and no less than
    `percent` of it; higher scores come first, of ties the smaller key. Rows with a null key, label or vector, or a null or non-finite
    component take no part. Vectors are compared with those of their own length; rows that repeat an anchor's key are no candidates for
    it, and each is an anchor of its own; other repeats are candidates each. Scores beyond 64 bits count as the largest or smallest
    64-bit number. Other columns don't matter; an empty table gives no rows. pivots: the most that are drawn, one for about 64 anchors.
    """
    table = prepared(vectors, key, vector, label, every, scale)
    cells = chosen(table, pivots)
    asked = table.where("anchor").drop("anchor")
    sizes = {"unit_rows": unit_rows, "unit_anchors": unit_anchors}

    _, groups = reach(cells, asked.withColumn("least", F.lit(None).cast("double")).withColumn("most", F.lit(None).cast("double")), CLASSES)
    near = ranked(joined(cells, table, asked, CLASSES, None, groups, best_of_label(positives), BEST, **sizes), ["row"], positives, "place")
    bound = near.groupBy("row").agg(F.count_if(F.col("place") == positives).alias("full"), F.min("score").alias("worst"))
    bound = bound.select(F.col("row").alias("of"), F.when(F.col("full") > 0, F.col("worst").cast("double")).alias("least"))
    bounded = asked.join(bound, F.col("row") == F.col("of"), "left").drop("of").withColumn("most", F.lit(None).cast("double"))
    bounded = materialize(bounded, "anchors-bounded")

    ring, groups = reach(cells, bounded, CLASSES)
    found = ranked(joined(cells, table, bounded, CLASSES, ring, groups, best_of_label(positives), BEST, **sizes), ["row"], positives, "place")
    lists = found.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "other", "score"))).alias("positives"), F.min("score").alias("low"), F.max("score").cast("double").alias("most"))
    with_lists = asked.join(lists, F.col("row") == F.col("of")).where("most >= 0").drop("of")
    # A positive below zero has no negatives: what is no more than it is less than its share.
    with_lists = materialize(with_lists.withColumn("least", F.greatest("low", F.lit(0)) * F.lit(percent / 100.0)).drop("low"), "anchors-positives")
    forget(bounded)

    ring, groups = reach(cells, with_lists, 1)
    out = joined(cells, table, with_lists, 1, ring, groups, best_in_bands(count, percent), BANDS, **sizes)
    out = ranked(out, ["row", "place"], count, "rank")
    out = materialize(out.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
    forget(table, with_lists)
    return out
