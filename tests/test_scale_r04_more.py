"""Findings of round 4 on long series, many series and simulations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import queries
from tideline.operators import checks, collection, dynamics, windows
from tideline.operators.collection import Collection, CollectionError
from tideline.sources import systems


def test_states_of_a_batch_move_together(spark):
    """the system is called for batches of states, not for each; either way gives the same series."""
    times, calls = np.linspace(0, 1, 6), spark.sparkContext.accumulator(0)
    draw = np.random.default_rng(3).normal(size=(300, 4)).tolist()
    states = Collection.of(spark.createDataFrame([(i, float(i % 3), *r) for i, r in enumerate(draw)], "id long, time double, a double, b double, c double, d double").coalesce(1))

    def counted(t, x, u):
        calls.add(1)
        return systems.burger(t, x, u)

    got = {(r[0], r[1]): r[2:] for r in systems.simulate_from(states, counted, times, 5).df.collect()}
    assert calls.value == 5 * 5 * 4
    want = {(r[0], r[1]): r[2:] for r in systems.simulate_from(states, systems.burger, times, 5, one_by_one=True).df.collect()}
    assert got.keys() == want.keys() and len(got) == 1800 and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_a_long_series_is_dealt_over_more_tasks(spark, monkeypatch):
    """No task holds a series, and longer ones have more tasks."""
    monkeypatch.setattr(collection, "TASK_ROWS", 100)
    one = Collection.of(spark.range(2000).select(F.lit(0).alias("id"), F.col("id").alias("time"), F.sin("id").alias("a")))
    made = windows.shift_pairs(one, piece=16)
    most = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert made.count() == 1999 and most < 1000
    assert made.rdd.getNumPartitions() == 20


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_series_of_orders_are_shuffled_once(spark):
    """What follows by order reads its buckets."""
    state, u = queries.orders(spark, "/root/testdata/sf0.001")
    assert shuffles(windows.shift_pairs(state)) == shuffles(u.drop_last(1).df) == shuffles(checks.control_follows(state.initial_states(1), u)) == 0
    pairs = dynamics.controlled_pairs(state, u, ["x_next"], ["a", "b", "c"])
    assert shuffles(pairs) == 2 and pairs.where("a + b + c > 0").count() == 0


def test_keys_are_compared_in_one_pass(spark):
    """F32: as multisets, over more tasks for more rows."""
    df = lambda keys: Collection.of(spark.createDataFrame([(*k, 1.0) for k in keys], "id long, time long, a double"))
    keys = [(1, 0), (1, 1), (2, 0), (2, 0)]
    assert checks.same_keys(df(keys), df(keys[::-1])) and not checks.same_keys(df(keys), df(keys[:3])) and not checks.same_keys(df(keys[:3]), df(keys))
    assert not checks.same_keys(df(keys), df([*keys[:3], (2, 1)]))


def test_one_pass_refuses_wrong_controls(spark):
    """counts of wrong keys come with the sums."""
    draw = np.random.default_rng(1)
    state = Collection.of(spark.createDataFrame([(i, t, float(draw.normal())) for i in range(4) for t in range(5)], "id long, time long, a double"))
    rows = [(i, t, float(draw.normal())) for i in range(4) for t in range(4)]
    u = lambda rows: Collection.of(spark.createDataFrame(rows, "id long, time long, u double"))
    assert np.isfinite(dynamics.ControlDmd().fit(state, u(rows), 1.0).system.matrix).all()
    for wrong, what in ((rows[1:], "1 missing"), ([*rows, rows[0]], "1 repeated"), ([*rows, (9, 0, 1.0)], "1 foreign")):
        with pytest.raises(CollectionError, match=what):
            dynamics.ControlDmd().fit(state, u(wrong), 1.0)
