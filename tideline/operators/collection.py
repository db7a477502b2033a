"""Time-series collections: many series in one DataFrame keyed by (id, time), one double column for each feature.

A DataFrame has no row order, so every operator orders by time within its id; nothing relies on how rows lie. No operator
sorts or numbers all rows in one task: numbers over the whole collection come from distributed running sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, NumericType, TimestampNTZType, TimestampType

#: Two float steps are equal within these, relative to the least one.
STEP_RTOL, STEP_ATOL = 3e-12, 1e-16


#: Rows of a task where operators deal rows themselves: of more rows there are more tasks, not larger ones.
TASK_ROWS = 1 << 19


class CollectionError(ValueError):
    """A collection doesn't have the property that an operator needs."""


def tasks(df: DataFrame, least: int | None = None) -> int:
    """Over how many tasks the rows of df are dealt: those of a shuffle (or `least`), or as many as TASK_ROWS says."""
    return max(least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def running_before(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """df with the sum of `value` over all rows that come before in `order` (rows must differ in it).

    Rows are dealt by ranges of the order; each range is summed on its own, and only the ranges' totals, one row
    each, meet in one place.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).persist()
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_n"))
    before_range = totals.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(F.broadcast(before_range), "_range").withColumn(out, (F.col(out) + F.col("_base")).cast("long")).drop("_range", "_base")


@dataclass(frozen=True)
class Collection:
    """A DataFrame with the roles of its columns. fixed_delta: then times are whole numbers of this step."""

    df: DataFrame
    features: tuple[str, ...]
    id: str = "id"
    time: str = "time"
    fixed_delta: float | None = None

    # -- construction ---------------------------------------------------------------------------------------------

    @staticmethod
    def of(df: DataFrame, id: str = "id", time: str = "time", features: Sequence[str] | None = None, fixed_delta: float | None = None) -> Collection:
        if fixed_delta is not None and fixed_delta <= 0:
            raise CollectionError("fixed_delta must be positive")
        names = tuple(features) if features is not None else tuple(c for c in df.columns if c not in (id, time))
        kinds = {f.name: f.dataType for f in df.schema.fields}
        if bad := [n for n in names if not isinstance(kinds[n], NumericType)]:
            raise CollectionError(f"features must be numeric: {bad}")
        if fixed_delta is not None and kinds[time].typeName() not in ("long", "integer", "short", "byte"):
            raise CollectionError("with fixed_delta times are whole numbers")
        return Collection(df.select(F.col(id).cast(LongType()).alias(id), time, *(F.col(n).cast("double").alias(n) for n in names)), names, id, time, fixed_delta)

    def with_df(self, df: DataFrame, features: Sequence[str] | None = None) -> Collection:
        return replace(self, df=df, features=tuple(features) if features is not None else self.features)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def by_time(self):
        return Window.partitionBy(self.id).orderBy(self.time)

    @property
    def is_datetime(self) -> bool:
        return isinstance(self.df.schema[self.time].dataType, (TimestampType, TimestampNTZType))

    def number(self, time: str | Column | None = None) -> Column:
        """Times as numbers: timestamps in microseconds."""
        t = F.col(self.time) if time is None else F.col(time) if isinstance(time, str) else time
        return F.unix_micros(t.cast("timestamp")) if self.is_datetime else t

    # -- selection ------------------------------------------------------------------------------------------------

    def select(self, *features: str | int) -> Collection:
        names = [self.features[f] if isinstance(f, int) else f for f in features]
        return self.with_df(self.df.select(self.id, self.time, *names), names)

    def at(self, ids: Sequence[int] | None = None, first=None, last=None) -> Collection:
        """Rows of some ids and of a closed time interval."""
        df = self.df if ids is None else self.df.where(F.col(self.id).isin(list(ids)))
        df = df if first is None else df.where(F.col(self.time) >= F.lit(first))
        return self.with_df(df if last is None else df.where(F.col(self.time) <= F.lit(last)))

    def cross_section(self, key, level: str = "id") -> DataFrame:
        """Rows of one id, without it, or of one time, without it."""
        drop = self.id if level == "id" else self.time
        return self.df.where(F.col(drop) == F.lit(key)).drop(drop)

    def select_times(self, times: Sequence | DataFrame) -> Collection:
        if isinstance(times, DataFrame):
            return self.with_df(self.df.join(times.select(F.col(times.columns[0]).alias(self.time)).distinct(), self.time, "left_semi"))
        return self.with_df(self.df.where(F.col(self.time).isin(list(times))))

    def initial_states(self, n: int = 1, strict: bool = False) -> Collection:
        """The first n rows of each series; strict: error if a series has fewer."""
        if strict and not self.n_timesteps().where(F.col("n_timesteps") < n).isEmpty():
            raise CollectionError(f"a series has fewer than {n} rows")
        return self.with_df(self.df.withColumn("_rn", F.row_number().over(self.by_time)).where(F.col("_rn") <= n).drop("_rn"))

    def final_states(self, n: int = 1) -> Collection:
        return self.with_df(self._from_end().where(F.col("_rn") <= n).drop("_rn"))

    def drop_last(self, n: int) -> Collection:
        return self.with_df(self._from_end().where(F.col("_rn") > n).drop("_rn"))

    def _from_end(self) -> DataFrame:
        return self.df.withColumn("_rn", F.row_number().over(Window.partitionBy(self.id).orderBy(F.desc(self.time))))

    def apply_series(self, func, schema) -> DataFrame:
        """func on each series as a pandas frame."""
        return self.df.groupBy(self.id).applyInPandas(func, schema)

    def pivot_feature(self, feature: str, times: Sequence) -> DataFrame:
        """A row for each id, a column for each of the given times."""
        named = [F.max(F.when(F.col(self.time) == F.lit(t), F.col(feature))).alias(f"{feature}_{t}") for t in times]
        return self.df.groupBy(self.id).agg(*named)

    def transpose(self) -> DataFrame:
        """A row for each feature and key: feature, id, time, value."""
        return self.df.unpivot([self.id, self.time], list(self.features), "feature", "value")

    def with_values(self, values: DataFrame, features: Sequence[str]) -> Collection:
        """The same keys with the columns of `values`, which must have exactly these keys."""
        return self.with_df(self.df.select(self.id, self.time).join(values, [self.id, self.time]), features)

    # -- aggregates -----------------------------------------------------------------------------------------------

    def ids(self) -> DataFrame:
        return self.df.select(self.id).distinct()

    def n_timesteps(self) -> DataFrame:
        return self.df.groupBy(self.id).agg(F.count(F.lit(1)).alias("n_timesteps"))

    def _steps(self) -> DataFrame:
        return self.df.select(self.id, self.time, (self.number() - F.lag(self.number()).over(self.by_time)).alias("_step"))

    def overview(self) -> DataFrame:
        """Per id: n_timesteps, start, end, delta (null for irregular series and for single samples; microseconds for timestamps)."""
        least, most = F.min("_step"), F.max("_step")
        kind = self.df.select(self.number().alias("t")).schema["t"].dataType.typeName()
        same = (most - least < STEP_ATOL) | (most - least < STEP_RTOL * least) if kind in ("double", "float") else most == least
        factor = F.lit(1 if self.fixed_delta is None else self.fixed_delta)
        return self._steps().groupBy(self.id).agg(F.count(F.lit(1)).alias("n_timesteps"), F.min(self.time).alias("start"), F.max(self.time).alias("end"), F.when(same, least * factor).alias("delta"))

    def delta_time(self) -> DataFrame:
        return self.overview().select(self.id, "delta")

    def time_interval(self) -> DataFrame:
        return self.df.agg(F.min(self.time).alias("start"), F.max(self.time).alias("end"))

    def time_values(self) -> DataFrame:
        return self.df.select((F.col(self.time) * self.fixed_delta if self.fixed_delta else F.col(self.time)).alias(self.time)).distinct()

    def const_sampled_times(self, delta) -> DataFrame:
        """Every time from the first to the last by delta."""
        span = self.time_interval()
        steps = F.sequence(F.lit(0), F.floor((F.col("end") - F.col("start")) / F.lit(delta) + F.lit(1e-9)).cast("long"))
        return span.select(F.explode(steps).alias("_i"), "start").select((F.col("start") + F.col("_i") * F.lit(delta)).alias(self.time))

    # -- time and identity ----------------------------------------------------------------------------------------

    def shift_time(self, delta) -> Collection:
        return self.with_df(self.df.withColumn(self.time, F.col(self.time) + F.lit(delta)))

    def shift_each_to(self, start=0) -> Collection:
        """Each series begins at `start`."""
        first = F.min(self.time).over(Window.partitionBy(self.id))
        return self.with_df(self.df.withColumn(self.time, F.col(self.time) - first + F.lit(start)))

    def normalize_time(self, delta) -> Collection:
        """Whole steps of `delta` since the collection's first time (rounded down)."""
        first = self.df.agg(F.min(self.number()).alias("_first"))
        step = ((self.number() - F.col("_first")) / F.lit(delta)).cast("long")
        return self.with_df(self.df.crossJoin(F.broadcast(first)).withColumn(self.time, step).drop("_first"))

    def expand_times(self, times: Sequence, fill: float = 0.0) -> Collection:
        """Adds rows at `times` to each series."""
        wanted = F.array(*map(F.lit, times)).cast(ArrayType(self.df.schema[self.time].dataType))
        added = self.ids().select(self.id, F.explode(wanted).alias(self.time), *(F.lit(float(fill)).alias(f) for f in self.features))
        return self.with_df(self.df.unionByName(added))

    def fill_to(self, n: int, delta=1) -> Collection:
        """Repeats each series' last state, a step at a time, until it has n rows."""
        last = self.final_states(1).df.join(self.n_timesteps(), self.id).where(F.col("n_timesteps") < n)
        more = last.select(self.id, F.explode(F.sequence(F.lit(1), (F.lit(n) - F.col("n_timesteps")).cast("int"))).alias("_i"), self.time, *self.features)
        more = more.withColumn(self.time, (F.col(self.time) + F.col("_i") * F.lit(delta)).cast(self.df.schema[self.time].dataType)).drop("_i")
        return self.with_df(self.df.unionByName(more.select(*self.df.columns)))

    def assign_ids_sequential(self) -> Collection:
        """Ids 0, 1, ... in the order of the old ones."""
        fresh = running_before(self.ids().withColumn("_one", F.lit(1)), [self.id], "_one", "_new").select(self.id, "_new")
        return self.with_df(self.df.join(fresh, self.id).withColumn(self.id, F.col("_new")).drop("_new"))

    def with_position(self, out: str = "position") -> DataFrame:
        """df with each row's place, from 0, in the order of id and time."""
        begin = running_before(self.n_timesteps(), [self.id], "n_timesteps", "_begin").select(self.id, "_begin")
        return self.df.join(begin, self.id).withColumn(out, F.col("_begin") + F.row_number().over(self.by_time) - 1).drop("_begin")

    def assign_ids_train_test(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """Rows with `fold` (train, test or dropped) and ids that start anew wherever fold or series change or a row is dropped.

        train, test: one column of row positions each.
        """
        folds = train.select(F.col(train.columns[0]).alias("position"), F.lit("train").alias("fold")).unionByName(test.select(F.col(test.columns[0]).alias("position"), F.lit("test").alias("fold")))
        rows = self.with_position().join(folds, "position", "left").withColumn("fold", F.coalesce("fold", F.lit("dropped")))
        before = F.lag("fold").over(self.by_time)
        rows = rows.withColumn("_new", (before.isNull() | (before != F.col("fold")) | (F.col("fold") == "dropped")).cast("int"))
        parts = rows.groupBy(self.id).agg(F.sum("_new").alias("_parts"))
        begin = running_before(parts, [self.id], "_parts", "_begin").select(self.id, "_begin")
        local = F.sum("_new").over(self.by_time)
        return rows.join(begin, self.id).withColumn("_id", F.col("_begin") + local - 1).withColumn(self.id, F.col("_id").cast("long")).drop("_id", "_new", "_begin")

    def sessions(self, drop_samples: bool = False) -> Collection:
        """Cuts irregular series into the longest runs of constant step and numbers all series anew.

        A row begins a run if the step changes once there, or if it comes right after a gap between two steps that both
        differ. Series of two rows and of constant step stay whole. Runs of one row are an error, or dropped; a series of
        which only two rows are left then goes too.
        """
        step = self.number() - F.lag(self.number()).over(self.by_time)
        rows = self.df.withColumn("_d", step).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(self.id)))
        # The change of step that follows a row: always one after the first row, none after the last.
        after = F.lead("_d").over(self.by_time)
        rows = rows.withColumn("_change", F.when(F.lag("_n").over(self.by_time).isNull(), True).when(after.isNull(), False).otherwise(after != F.col("_d")))
        rows = rows.withColumn("_pair", F.col("_change") & F.coalesce(F.lead("_change").over(self.by_time), F.lit(False)))
        gap = F.coalesce(F.lag("_pair").over(self.by_time), F.lit(False))
        rows = rows.withColumn("_begins", gap | (F.col("_change") & ~F.col("_pair") & ~gap))
        every = Window.partitionBy(self.id)
        rows = rows.withColumn("_regular", F.max("_d").over(every).eqNullSafe(F.min("_d").over(every)))
        whole = (F.col("_n") == 2) | (F.col("_regular") & (F.col("_n") > 1))
        rows = rows.withColumn("_run", F.when(whole, F.lit(0)).otherwise(F.sum(F.col("_begins").cast("int")).over(self.by_time)))
        rows = rows.withColumn("_length", F.count(F.lit(1)).over(Window.partitionBy(self.id, "_run")))
        if drop_samples:
            rows = rows.where(F.col("_length") > 1).withColumn("_left", F.count(F.lit(1)).over(every)).where(whole | (F.col("_left") != 2)).drop("_left")
        elif not rows.where(F.col("_length") == 1).isEmpty():
            raise CollectionError("a run of constant step has a single sample; drop_samples leaves such runs out")
        runs = rows.select(self.id, "_run").distinct().withColumn("_one", F.lit(1))
        fresh = running_before(runs, [self.id, "_run"], "_one", "_new").select(self.id, "_run", "_new")
        out = rows.join(fresh, [self.id, "_run"]).withColumn(self.id, F.col("_new"))
        return self.with_df(out.select(*self.df.columns))

    def windows(self, size: int, offset: int, per_series: bool = False) -> DataFrame:
        """Sliding windows over distinct times (of each series, or of all): rows with `window` numbers from 0. Full windows only."""
        part = [self.id] if per_series else []
        if per_series:
            at = self.df.select(self.id, self.time).withColumn("_i", F.row_number().over(self.by_time) - 1)
            count = F.count(F.lit(1)).over(Window.partitionBy(self.id))
        else:
            times = running_before(self.df.select(self.time).distinct().withColumn("_one", F.lit(1)), [self.time], "_one", "_i")
            at, count = times.select(self.time, "_i").crossJoin(F.broadcast(times.agg(F.count(F.lit(1)).alias("_all")))), F.col("_all")
        first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (size - 1)) / F.lit(offset))).cast("long")
        last = F.least(F.floor(F.col("_i") / F.lit(offset)), F.floor((F.col("_total") - size) / F.lit(offset))).cast("long")
        at = at.withColumn("_total", count).withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
        at = at.select(*part, self.time, F.explode(F.sequence("_a", "_b")).alias("window"))
        return self.df.join(at, [*part, self.time])

    # -- combination ----------------------------------------------------------------------------------------------

    def insert(self, series: DataFrame, id: int | None = None) -> Collection:
        """Adds one series (time and features) under an id, by default the one after the largest."""
        if id is None:
            new = series.crossJoin(F.broadcast(self.df.agg((F.max(self.id) + 1).alias(self.id))))
        else:
            if not self.df.where(F.col(self.id) == id).isEmpty():
                raise CollectionError(f"id {id} is taken")
            new = series.withColumn(self.id, F.lit(id).cast("long"))
        return self.with_df(self.df.unionByName(new.select(*self.df.columns)))

    def join_features(self, other: Collection) -> Collection:
        """Features of both, where both have the key."""
        taken = [f for f in other.features if f not in self.features]
        right = other.df.select(F.col(other.id).alias(self.id), F.col(other.time).alias(self.time), *taken)
        return self.with_df(self.df.join(right, [self.id, self.time]), [*self.features, *taken])

    def augment_control(self, control: Collection) -> Collection:
        """Adds controls one step later: row t + 1 has the control of t, a series' first row null."""
        right = control.df.select(F.col(control.id).alias(self.id), F.col(control.time).alias(self.time), *control.features)
        both = self.df.join(right, [self.id, self.time], "left")
        return self.with_df(both.select(self.id, self.time, *self.features, *(F.lag(c).over(self.by_time).alias(c) for c in control.features)), [*self.features, *control.features])

    def same_start_groups(self) -> DataFrame:
        """Per id the group of series that share start, end and step, named by its least id."""
        over = self.overview()
        return over.withColumn("group", F.min(self.id).over(Window.partitionBy("start", "end", "delta")))
