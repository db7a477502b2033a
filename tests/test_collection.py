"""Collections, checks, windows and folds on literal series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions.linalg import fd_stencil
from tideline.operators import checks, metrics, splits, windows
from tideline.operators.collection import Collection, CollectionError, running_before
from tideline.plans import transformers
from tideline.sources import io


def series(spark, keys, a=None, b=None):
    n = len(keys)
    a = list(range(0, 2 * n, 2)) if a is None else a
    b = list(range(1, 2 * n, 2)) if b is None else b
    return Collection.of(spark.createDataFrame([(i, t, float(x), float(y)) for (i, t), x, y in zip(keys, a, b, strict=True)], "id long, time long, A double, B double"))


KEYS = [(0, 0), (0, 1), (1, 0), (1, 1), (15, 0), (15, 1), (45, 17), (45, 18), (45, 19)]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def simple(spark):
    return series(spark, KEYS)


def times(spark, *values, id=1):
    return Collection.of(spark.createDataFrame([(id, t, 0.0) for t in values], "id long, time long, A double"))


def test_shift_pairs(simple):
    got = windows.shift_pairs(simple)
    assert [tuple(r) for r in got.orderBy("id", "time").select("A", "A_next").collect()] == [(0, 2), (4, 6), (8, 10), (12, 14), (14, 16)]


def test_takens_short(simple):
    got = windows.takens(simple.select("A"), delays=1)
    assert rows(got.df, "A", "A:d1") == [(2, 0), (6, 4), (10, 8), (14, 12), (16, 14)]


def test_takens_kappa(spark):
    tsc = series(spark, [(0, t) for t in range(6)], range(6), range(6))
    row = windows.takens(tsc, delays=5, kappa=1.0).df.collect()
    assert len(row) == 1
    assert [row[0][f"A:d{k}"] for k in range(1, 6)] == pytest.approx([(5 - k) * math.exp(-k) for k in range(1, 6)])


@pytest.mark.parametrize(("how", "want"), [((1, 0, 1), [1]), ((2, 0, 1), [1, 2]), ((1, 1, 1), [2]), ((5, 1, 1), [2, 3, 4, 5, 6]), ((2, 2, 2), [3, 5]), ((4, 2, 2), [3, 5, 7, 9])])
def test_delay_indices(how, want):
    assert windows.delay_indices(*how) == want


def test_delay_indices_refuse_a_frequency_without_delays():
    with pytest.raises(CollectionError):
        windows.delay_indices(1, 0, 2)


@pytest.mark.parametrize(("how", "want"), [
    (dict(order=1), range(1, 9)), (dict(order=1, shift_index=True), range(2, 10)), (dict(order=1, scheme="backward"), range(2, 10)), (dict(order=1, scheme="forward"), range(0, 8)),
    (dict(order=1, scheme="forward", shift_index=True), range(2, 10)), (dict(order=2), range(1, 9)), (dict(order=2, scheme="backward"), range(3, 10)), (dict(order=2, scheme="forward"), range(0, 7)),
])
def test_finite_differences_of_a_line(spark, how, want):
    tsc = series(spark, [(0, t) for t in range(10)], [2 * t for t in range(10)], [2 * t + 1 for t in range(10)])
    got = windows.finite_difference(tsc, 1.0, **how).df.orderBy("time").collect()
    assert [r["time"] for r in got] == list(want)
    assert all(abs(r["A"] - (2 if how["order"] == 1 else 0)) < 1e-9 for r in got)


def test_stencils():
    assert fd_stencil("center", 1, 2) == ([-1, 0, 1], pytest.approx([-0.5, 0, 0.5]))
    assert fd_stencil("center", 1, 4)[1] == pytest.approx([1 / 12, -8 / 12, 0, 8 / 12, -1 / 12])
    assert fd_stencil("forward", 1, 2)[1] == pytest.approx([-1.5, 2, -0.5])


def sessions(spark, *values, **how):
    got = times(spark, *values).sessions(**how).df.orderBy("id", "time").collect()
    return [(r["id"], r["time"]) for r in got]


def test_sessions_after_a_gap(spark):
    assert sessions(spark, 0, 1, 2, 3, 10, 11, 12, 13) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 10), (1, 11), (1, 12), (1, 13)]
    assert sessions(spark, 0, 1, 2, 3, 10, 12) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 10), (1, 12)]


def test_sessions_with_single_samples(spark):
    with pytest.raises(CollectionError):
        sessions(spark, 1, 7, 8, 9, 10)
    assert sessions(spark, 1, 7, 8, 9, 10, drop_samples=True) == [(0, 7), (0, 8), (0, 9), (0, 10)]
    with pytest.raises(CollectionError):
        sessions(spark, 1, 5, 7, 14, 19)
    assert sessions(spark, 1, 5, 7, 14, 19, drop_samples=True) == []


def test_train_test_ids(spark):
    tsc = times(spark, *range(10), id=0)
    fold = lambda *at: spark.createDataFrame([(i,) for i in at], "position long")
    got = tsc.assign_ids_train_test(fold(0, 1, 3, 4), fold(5, 6, 8, 9))
    train, test = got.where("fold = 'train'"), got.where("fold = 'test'")
    groups = lambda df: sorted(sorted(r["t"]) for r in df.groupBy("id").agg(F.collect_list("time").alias("t")).collect())
    assert groups(train) == [[0, 1], [3, 4]] and groups(test) == [[5, 6], [8, 9]]


def test_control_joins_one_step_later(spark):
    x = Collection.of(spark.createDataFrame([(1, t, float(t)) for t in range(3)], "id long, time long, x1 double"))
    u = Collection.of(spark.createDataFrame([(1, t, 10.0 + t) for t in range(2)], "id long, time long, u1 double"))
    assert [r["u1"] for r in x.augment_control(u).df.orderBy("time").collect()] == [None, 10.0, 11.0]
    assert checks.control_matches(x, u)


def test_checks(spark, simple):
    c = checks.Checked(simple)
    assert c.valid and c.finite and c.const_delta and c.delta == 1 and not c.equal_length and not c.has_degenerate
    with pytest.raises(CollectionError):
        c.require(same_length=True)
    with pytest.raises(CollectionError):
        c.require(delta=2.0)
    odd = series(spark, [(0, 0), (0, 2), (0, 3), (7, 1)], [1, float("nan"), 2, 3])
    c = checks.Checked(odd)
    assert not c.finite and not c.const_delta and c.has_degenerate
    assert rows(checks.degenerate_ids(odd), "id") == [(7,)]
    assert not checks.overlapping_times(simple).isEmpty()
    with pytest.raises(CollectionError):
        Collection.of(spark.createDataFrame([(1, 1, "x")], "id long, time long, A string"))


def test_float_steps_are_equal_within_tolerance(spark):
    t = np.linspace(0, 1, 11)
    tsc = Collection.of(spark.createDataFrame([(0, float(v), 1.0) for v in t], "id long, time double, A double"))
    assert tsc.delta_time().first()["delta"] == pytest.approx(0.1)


def test_identity_of_series(spark, simple):
    assert {r["id"] for r in simple.assign_ids_sequential().ids().collect()} == {0, 1, 2, 3}
    both = io.concat([simple, simple])
    assert both.ids().count() == 8 and both.df.count() == 18
    assert rows(simple.with_position(), "position", "id", "time") == [(p, i, t) for p, (i, t) in enumerate(KEYS)]
    assert simple.insert(simple.cross_section(0)).ids().count() == 5
    with pytest.raises(CollectionError):
        simple.insert(simple.cross_section(0), id=1)


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = running_before(df.repartition(8), ["id"], "v", "s").orderBy("id").collect()
    assert [r["s"] for r in got] == np.cumsum([0, *(i % 7 for i in range(999))]).tolist()


def test_windows_over_times(spark):
    got = times(spark, 0, 1, 2, 3, 4, 5).windows(3, 2)
    assert rows(got, "window", "time") == [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (1, 4)]


def test_time_arithmetic(spark, simple):
    assert {r["time"] for r in simple.shift_each_to(0).df.where("id = 45").collect()} == {0, 1, 2}
    assert simple.normalize_time(1).df.agg(F.max("time")).first()[0] == 19
    assert simple.fill_to(4).n_timesteps().where("n_timesteps <> 4").isEmpty()
    assert simple.expand_times([100]).df.count() == 13


def test_fold_series_and_time(spark):
    tsc = series(spark, [(i, t) for i in (0, 1, 15, 45) for t in range(4)])
    assert [sorted(r["id"] for r in test.ids().collect()) for _, test in splits.splits(tsc, "series", 2)] == [[0, 1], [15, 45]]
    assert [sorted({r["time"] for r in test.df.collect()}) for _, test in splits.splits(tsc, "time", 4)] == [[0], [1], [2], [3]]
    train, _ = list(splits.splits(tsc, "time", 4))[1]
    assert train.ids().count() == 8  # each series is cut in two


def test_window_folds_from_the_end(spark):
    tsc = series(spark, [(0, t) for t in range(5)] + [(1, t) for t in range(10, 15)])
    position = {k: p for p, k in enumerate([(0, t) for t in range(5)] + [(1, t) for t in range(10, 15)])}
    got = [sorted(position[r["id"], r["time"]] for r in test.df.collect()) for _, test in splits.splits(tsc, "window", length=3)]
    assert sorted(got) == [[2, 3, 4], [7, 8, 9]]
    long = series(spark, [(0, t) for t in range(5)] + [(1, t) for t in range(10, 12)])
    got = [sorted(r["time"] for r in test.df.collect()) for _, test in splits.splits(long, "window", length=2)]
    assert sorted(got) == [[1, 2], [3, 4], [10, 11]]


@pytest.mark.parametrize("mode", ["timeseries", "timestep", "feature"])
def test_metrics_match_numpy(spark, mode):
    draw = np.random.default_rng(5)
    keys = [(i, t) for i in range(3) for t in range(10)]
    y, p = draw.uniform(size=(30, 2)), draw.uniform(size=(30, 2))
    true, made = series(spark, keys, *y.T), series(spark, keys, *p.T)
    groups = {"timeseries": [k[0] for k in keys], "timestep": [k[1] for k in keys], "feature": [0] * 30}[mode]
    e = y - p
    functions = {"rmse": lambda e, y: np.sqrt((e**2).mean()), "mae": lambda e, y: np.abs(e).mean(), "medae": lambda e, y: np.median(np.abs(e)), "max": lambda e, y: np.abs(e).max(), "l2": lambda e, y: np.sqrt((e**2).sum()), "rrmse": lambda e, y: np.sqrt((e**2).mean() / (y**2).sum()), "mape": lambda e, y: (np.abs(e) / np.abs(y)).mean()}
    for name, f in functions.items():
        got = metrics.score_frame(true, made, name, mode)
        by = {(r[0] if mode != "feature" else 0): r["A"] for r in got.collect()}
        for g in set(groups):
            at = [k for k, v in enumerate(groups) if v == g]
            assert by[g] == pytest.approx(f(e[at, 0], y[at, 0]))
    with pytest.raises(CollectionError):
        metrics.score_frame(true, made.drop_last(1))


def test_polynomials(simple):
    t = transformers.Polynomial(2).fit(simple)
    assert t.transform(simple).features == ("A^2", "A B", "B^2")
    assert transformers.Polynomial(3, interaction_only=True, bias=True, first_order=True).fit(simple).transform(simple).features == ("1", "A", "B", "A B")


def test_scalers_and_components_invert(simple):
    for t in (transformers.Scale("standard"), transformers.Scale("min-max"), transformers.Principal(), transformers.Takens(1), transformers.Identity(const=True, rename=True)):
        back = t.inverse(t.fit_transform(simple)).df.orderBy("id", "time").collect()
        want = {(r["id"], r["time"]): (r["A"], r["B"]) for r in simple.df.collect()}
        assert back and all((r["A"], r["B"]) == pytest.approx(want[r["id"], r["time"]]) for r in back)
    assert transformers.Scale("standard").fit(series(simple.spark, KEYS, [3] * 9)).size[0] == 1.0


def test_incremental_components_equal_one_fit(simple):
    one = transformers.Principal().fit(simple)
    two = transformers.Principal()
    for part in ("id < 10", "id >= 10"):
        two.partial_fit(simple.with_df(simple.df.where(part)))
    assert np.allclose(one.components, two.components) and np.allclose(one.variances, two.variances)


def test_columns_and_pipeline(simple):
    made = transformers.Columns([(transformers.Takens(1), ["A"]), (transformers.Polynomial(2), ["B"])], remainder=True).fit_transform(simple)
    assert made.features == ("A", "A:d1", "B^2") and made.df.count() == 5
    p = transformers.Pipeline([transformers.Scale("center"), transformers.Takens(1)])
    assert p.fit_transform(simple).df.count() == 5 and len(p[:1].steps) == 1


def test_csv_round_trip(spark, simple, tmp_path):
    io.to_csv(simple, str(tmp_path / "x"))
    assert rows(io.from_csv(spark, str(tmp_path / "x")).df, "id", "time", "A", "B") == rows(simple.df, "id", "time", "A", "B")
