"""Properties of a collection: each is one aggregate over it, as a yes or no or as a check that raises."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.collection import Collection, CollectionError, tasks

INF = float("inf")


def summary(tsc: Collection) -> DataFrame:
    """One row with what the checks need of the whole collection, from one pass over the series."""
    bad = F.lit(False)
    for f in tsc.features:
        bad = bad | F.col(f).isNull() | F.isnan(f) | (F.abs(F.col(f)) == INF)
    marked = tsc.df.withColumn("_bad", bad.cast("int")).withColumn("_again", (F.lag(tsc.time).over(tsc.by_time) == F.col(tsc.time)).cast("int"))
    marked = marked.withColumn("_step", tsc.number() - F.lag(tsc.number()).over(tsc.by_time))
    least, most = F.min("_step"), F.max("_step")
    per = marked.groupBy(tsc.id).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("bad"), F.sum("_again").alias("again"), F.min(tsc.number()).alias("start"),
        F.when((most - least).cast("double") <= F.abs(least).cast("double") * 3e-12 + 1e-16, least).cast("double").alias("delta"),
    )
    times = tsc.df.agg(F.count_distinct(tsc.time).alias("n_times"))
    return per.agg(
        F.count(F.lit(1)).alias("n_series"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.min("n").alias("least_n"), F.max("n").alias("most_n"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("not_finite"), F.coalesce(F.sum("again"), F.lit(0)).alias("repeated"), F.min(tsc.id).alias("least_id"), F.min("start").alias("start"),
        F.count("delta").alias("with_delta"), F.min("delta").alias("least_delta"), F.max("delta").alias("most_delta"), F.sum((F.col("n") == 1).cast("int")).alias("degenerate"),
    ).crossJoin(times)


class Checked:
    """A collection's properties, worked out once."""

    def __init__(self, tsc: Collection) -> None:
        self.tsc, self.row = tsc, summary(tsc).first()

    @property
    def valid(self) -> bool:
        return not self.row["repeated"] and (self.row["least_id"] is None or self.row["least_id"] >= 0)

    @property
    def finite(self) -> bool:
        return not self.row["not_finite"]

    @property
    def equal_length(self) -> bool:
        return self.row["least_n"] == self.row["most_n"]

    @property
    def const_delta(self) -> bool:
        r = self.row
        return r["with_delta"] == r["n_series"] > 0 and abs(r["most_delta"] - r["least_delta"]) <= 1e-16 + 3e-12 * abs(r["least_delta"])

    @property
    def delta(self) -> float | None:
        return self.row["least_delta"] * (self.tsc.fixed_delta or 1) if self.const_delta else None

    @property
    def same_times(self) -> bool:
        return self.equal_length and self.row["n_times"] == self.row["most_n"]

    @property
    def normalized_time(self) -> bool:
        return self.row["start"] == 0 and self.const_delta and self.row["least_delta"] == 1

    @property
    def has_degenerate(self) -> bool:
        return bool(self.row["degenerate"])

    def require(self, finite: bool = True, const_delta: bool = True, no_degenerate: bool = True, same_length: bool = False, same_times: bool = False, normalized: bool = False, delta: float | None = None, n_series: int | None = None, n_timesteps: int | None = None, min_timesteps: int | None = None, min_samples: int | None = None, min_features: int | None = None) -> Checked:
        r, step = self.row, self.delta
        for wrong, what in (
            (not self.valid, "ids are at least 0 and (id, time) is unique"),
            (finite and not self.finite, "values are finite"),
            (no_degenerate and self.has_degenerate, "no series has a single sample"),
            (const_delta and not self.const_delta, "all series have one constant step"),
            (same_length and not self.equal_length, "series have equal length"),
            (same_times and not self.same_times, "series have the same times"),
            (normalized and not self.normalized_time, "time starts at 0 with step 1"),
            (delta is not None and (step is None or abs(step - delta) > 1e-15 + 1e-12 * abs(delta)), f"the step is {delta}"),
            (n_series is not None and r["n_series"] != n_series, f"there are {n_series} series"),
            (n_timesteps is not None and not (r["least_n"] == r["most_n"] == n_timesteps), f"series have {n_timesteps} samples"),
            (min_timesteps is not None and (r["least_n"] or 0) < min_timesteps, f"series have {min_timesteps} samples or more"),
            (min_samples is not None and r["n_rows"] < min_samples, f"there are {min_samples} samples or more"),
            (min_features is not None and len(self.tsc.features) < min_features, f"there are {min_features} features or more"),
        ):
            if wrong:
                raise CollectionError(f"it doesn't hold that {what}")
        return self


def degenerate_ids(tsc: Collection) -> DataFrame:
    return tsc.n_timesteps().where("n_timesteps = 1").select(tsc.id)


def overlapping_times(tsc: Collection) -> DataFrame:
    """Times that occur in more than one row."""
    return tsc.df.groupBy(tsc.time).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_ids(tsc: Collection, wanted: DataFrame) -> DataFrame:
    """Ids in one of the two only, with `where`: collection or wanted."""
    other = wanted.select(F.col(wanted.columns[0]).cast("long").alias(tsc.id)).distinct()
    have = tsc.ids()
    return have.join(other, tsc.id, "left_anti").withColumn("where", F.lit("collection")).unionByName(other.join(have, tsc.id, "left_anti").withColumn("where", F.lit("wanted")))


def same_keys(left: Collection, right: Collection, n: int | None = None) -> bool:
    """Whether both have the same keys as often, in one pass; keys are dealt over n tasks."""
    signed = [c.df.select(F.col(c.id).alias("id"), F.col(c.time).alias("time"), F.lit(sign).alias("_s")) for c, sign in ((left, 1), (right, -1))]
    both = signed[0].unionByName(signed[1]).repartition(n or tasks(left.df), "id", "time")
    return both.groupBy("id", "time").agg(F.sum("_s").alias("_s")).where("_s <> 0").isEmpty()


def control_matches(state: Collection, control: Collection, last: bool = False) -> bool:
    """Whether controls have the keys of the states, less each series' last row unless `last`."""
    return same_keys(state if last else state.drop_last(1), control, tasks(state.df))


def control_follows(initial: Collection, control: Collection) -> DataFrame:
    """Ids whose last initial time isn't the first control time."""
    last = initial.df.groupBy(initial.id).agg(F.max(initial.time).alias("last"))
    first = control.df.groupBy(F.col(control.id).alias(initial.id)).agg(F.min(control.time).alias("first"))
    return last.join(first, initial.id, "full").where(~F.col("last").eqNullSafe(F.col("first")))


def duplicates(tsc: Collection) -> DataFrame:
    """Keys with more than one row."""
    return tsc.df.groupBy(tsc.id, tsc.time).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def asymmetric_edges(edges: DataFrame, tol: float = 0.0) -> DataFrame:
    """Entries (i, j) of an edge list that differ from their mirror by more than tol (a missing one counts as 0)."""
    upper = F.col("i") <= F.col("j")
    both = edges.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum(F.when(upper, F.col("w"))).alias("up"), F.sum(F.when(F.col("i") >= F.col("j"), F.col("w"))).alias("down"))
    apart = both.where(F.abs(F.coalesce("up", F.lit(0.0)) - F.coalesce("down", F.lit(0.0))) > tol)
    sides = F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), F.col("up").alias("w"), F.col("down").alias("m")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), F.col("down").alias("w"), F.col("up").alias("m")))
    return apart.select(F.inline(sides))


def not_stochastic(edges: DataFrame, tol: float = 1e-13, copies: str | None = None) -> DataFrame:
    """Rows whose entries don't add up to 1. copies: a column that tells how many equal entries of its row an entry stands for."""
    return edges.groupBy("i").agg(F.sum("w" if copies is None else F.col("w") * F.col(copies)).alias("total")).where(F.abs(F.col("total") - 1) > tol)


def out_of_order(tsc: Collection, order: str) -> DataFrame:
    """Rows whose time isn't above that of the row before in `order` (a column that tells how rows were written)."""
    before = F.lag(tsc.time).over(Window.partitionBy(tsc.id).orderBy(order))
    return tsc.df.withColumn("_before", before).where(F.col("_before") >= F.col(tsc.time)).drop("_before")
