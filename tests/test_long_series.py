"""Windows over pieces of long series, low-rank states of streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import windows
from tideline.operators.collection import Collection, CollectionError
from tideline.streaming import online


@pytest.fixture(scope="module")
def series(spark):
    draw = np.random.default_rng(5)
    rows = [(i, int(t), float(draw.normal()), None if t == 9 else float(t)) for i, n in enumerate((1, 2, 5, 6, 7, 40, 41)) for t in np.sort(draw.choice(200, n, replace=False))]
    return Collection.of(spark.createDataFrame(rows, "id long, time long, a double, b double"))


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("piece", [6, 7, 40, 1000])
def test_pieces_give_the_same_rows(series, piece):
    for run in (
        lambda **how: windows.shift_pairs(series, **how),
        lambda **how: windows.takens(series, 3, 1, 2, **how).df,
        lambda **how: windows.moving_average(series, 4, **how).df,
        *(lambda scheme=scheme, shift=shift, **how: windows.finite_difference(series, 1.0, scheme, 1, 4, shift, **how).df for scheme in ("center", "forward", "backward") for shift in (False, True)),
    ):
        assert rows_of(run(piece=piece)) == rows_of(run())


def test_a_piece_is_as_long_as_its_halo(series):
    with pytest.raises(CollectionError):
        windows.takens(series, 9, piece=8)


def pairs(n, d, r, seed):
    draw = np.random.default_rng(seed)
    lift, a = draw.normal(size=(d, r)), np.diag(np.linspace(0.3, 0.9, r))
    x = draw.normal(size=(n, r))
    return x @ lift.T, x @ a @ lift.T, lift, a


def test_states_merge_in_any_order():
    x, y, lift, a = pairs(90, 12, 3, 1)
    whole = online.Bases.of(x, y, 5)
    parts = [online.Bases.of(x[i : i + 30], y[i : i + 30], 5) for i in (0, 30, 60)]
    for order in ((0, 1, 2), (2, 0, 1)):
        merged = parts[order[0]].merge(parts[order[1]]).merge(parts[order[2]])
        assert merged.n == whole.n == 90 and np.allclose(merged.matrix(), whole.matrix())
        assert np.allclose(np.sort(merged.modes()[0].real), np.diag(a)) and merged.u.shape[1] == 3
    back = online.Bases.unpacked(merged.packed(), 12, 5)
    assert np.allclose(back.matrix(), merged.matrix())


def test_rank_keeps_what_carries_most():
    x, y, lift, a = pairs(400, 10, 3, 2)
    noise = np.random.default_rng(3).normal(size=x.shape) * 1e-6
    state = online.Bases.of(x[:200] + noise[:200], y[:200], 3).merge(online.Bases.of(x[200:] + noise[200:], y[200:], 3))
    assert state.u.shape == (10, 3) and np.allclose(np.sort(state.modes()[0].real), np.diag(a), atol=1e-3)


def test_bases_of_a_table_and_of_a_restarted_stream(spark, tmp_path):
    draw = np.random.default_rng(4)
    a = np.array([[0.9, 0.2], [-0.1, 0.8]])
    rows = []
    for i in range(6):
        x = draw.normal(size=2)
        for t in range(8):
            rows.append((i, t, *map(float, x), float(x.sum())))
            x = a @ x
    tsc = Collection.of(spark.createDataFrame(rows, "id long, time long, p double, q double, s double"))
    whole = online.bases_of(windows.shift_pairs(tsc), list(tsc.features), 3, rows=5)
    assert whole.n == 42 and whole.u.shape[1] == 2 and np.allclose(np.sort_complex(whole.modes()[0]), np.sort_complex(np.linalg.eigvals(a)))
    for number, ids in ((0, (0, 1)), (1, (2, 3)), (1, (2, 3)), (2, (4, 5)), (2, (4, 5))):
        sink = online.BatchSink(list(tsc.features), path=f"file://{tmp_path}/bases", rank=3)
        sink(tsc.df.where(F.col("id").isin(*ids)), number)
    assert sink.state.bases.n == 42 and np.allclose(sink.state.bases.matrix(), whole.matrix())


def test_a_batch_whose_write_failed_is_added_when_it_comes_again(spark, tmp_path):
    tsc = Collection.of(spark.createDataFrame([(i, t, float(2**t)) for i in range(2) for t in range(3)], "id long, time long, x double"))
    sink = online.BatchSink(["x"], path="nowhere://x/y")
    sink.resumed = True
    with pytest.raises(Exception):
        sink(tsc.df, 0)
    assert sink.last == -1 and sink.state.n == 0
    sink.path = f"file://{tmp_path}/sums"
    sink(tsc.df, 0)
    assert sink.last == 0 and sink.state.n == 4
