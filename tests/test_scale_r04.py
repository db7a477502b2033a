"""Findings of round 4: clouds of several blocks, joins that must not be broadcast, sums without edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import blocked, checks, distance, kernels, pointcloud, regress
from tideline.operators.distance import pairwise


def cloud(spark, x):
    return spark.createDataFrame([(i * 3 + 1, r) for i, r in enumerate(np.asarray(x, float).tolist())], "point_id long, x array<double>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def edges_of(df):
    return sorted((r["i"], r["j"], round(r["d"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(90, 6)).round(1)
    return np.vstack([x, x[:7]])


def test_grid_is_not_broadcast(spark):
    """F2, F4, F15, F16, F17."""
    x = cloud(spark, [[0.0, 0.0], [0.5, 0.5], [3.0, 3.0]])
    for metric in ("euclidean", "cityblock", "chebyshev"):
        found = distance.grid(x, metric=metric, cut_off=1.5)
        assert "Broadcast" not in plan(found) and found.count() == 5


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine"])
def test_several_blocks_give_all_pairs(spark, points, metric):
    """Pairs of blocks of more than one block never met."""
    x, y = cloud(spark, points), cloud(spark, points[:40] + 0.05)
    for queries_, limit, k in ((None, None, None), (None, 1.1, None), (None, None, 4), (y, None, 5), (y, 1.5, None)):
        want = distance.full(x, queries_, metric, limit)
        want = want if k is None else distance.nearest(want, k)
        if metric == "cosine" and k is not None:
            continue  # multiples of a vector tie up to rounding
        assert edges_of(distance.blocks(x, queries_, metric, limit, k, rows=30)) == edges_of(want)


def test_near_pairs_equal_all_pairs(points):
    """products leave the pairs that differences would."""
    far = points + 1e4
    for a in (points, far, np.where(points > 2, np.nan, points)):
        d = pairwise(a, a, "euclidean")
        q, r, found = distance.near_pairs(a, a, "euclidean", 1.3)
        assert set(zip(q, r, strict=True)) == set(zip(*np.nonzero(d <= 1.3), strict=True)) and (found == d[q, r]).all()
        q, r, found = distance.near_pairs(a, a, "euclidean", None, 3)
        worst = np.sort(d, axis=1)[:, 2:3]
        assert set(zip(q, r, strict=True)) >= set(zip(*np.nonzero(d <= worst), strict=True)) and np.array_equal(found, d[q, r], equal_nan=True)


@pytest.mark.parametrize("name", sorted(kernels.BY_NAME))
def test_extents_equal_those_of_edges(spark, points, name):
    kernel = kernels.BY_NAME[name]()
    got = {r["point_id"]: r[1:] for r in blocked.extents(kernel, blocked.Blocks.of(cloud(spark, points), 25)).collect()}
    w = kernel.values(pairwise(points, points, kernel.metric))
    assert len(got) == len(points)
    for i, r in enumerate(w):
        assert np.allclose(got[i * 3 + 1], [r.sum(), r.min(), r.max()], atol=1e-6)


def test_continuous_knn_of_blocks_equals_that_of_edges(spark, points):
    x = cloud(spark, points)
    full = distance.full(x)
    want = kernels.continuous_knn(full, 9, 0.9)
    far = kernels.kth_distance(full, 9).withColumnRenamed("i", "point_id")
    got = blocked.continuous_knn(blocked.Blocks.of(x, 20), far, 0.9)
    assert sorted(map(tuple, got.collect())) == sorted((r["i"], r["j"]) for r in want.collect())


def test_cone_and_bandwidths_of_blocks_equal_those_of_edges(spark):
    """F3, F21."""
    draw = np.random.default_rng(6)
    x, v = draw.normal(size=(60, 2)), draw.normal(size=(60, 2))
    v[3] = 0
    states = cloud(spark, x).join(cloud(spark, v).withColumnRenamed("x", "v"), "point_id")
    want = {r["i"]: r["t"] for r in kernels.cone(states, 0.9, 2.0, 1.0).groupBy("i").agg(F.sum("w").alias("t")).collect()}
    over = blocked.Blocks.of(states.select("point_id", F.concat("x", "v").alias("x")), 17)
    got = {r["point_id"]: r["total"] for r in blocked.extents(kernels.cone_of_points(0.9, 2.0, 1.0), over).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    edges, rho = kernels.variable_bandwidth(cloud(spark, x), 0.5, 5, 2.0, -0.5)
    made = blocked.VariableBandwidth.of(cloud(spark, x), 0.5, 5, 2.0, -0.5, rows=17)
    assert np.allclose(sorted(map(tuple, rho.collect())), sorted(map(tuple, made.found.collect())))
    sums = edges.groupBy("i").agg(F.sum("w").alias("t"))
    assert np.allclose(sorted(map(tuple, sums.collect())), sorted(map(tuple, made.totals().collect())))


def test_pyramid_of_blocks(spark):
    t = np.linspace(0, 1, 70)
    x = cloud(spark, np.column_stack([t, t * t]))
    f = x.select("point_id", F.sin(F.element_at("x", 1) * 6).alias("f"))
    one, many = (regress.LaplacianPyramid(epsilon=1.0, auto=True, most=4, rows=rows).fit(x, f, "f") for rows in (100, 20))
    assert abs(one.error - many.error) < 1e-12 and one.over.blocks == 1 and many.over.blocks == 4
    assert np.allclose(sorted(map(tuple, one.predict(x).collect())), sorted(map(tuple, many.predict(x).collect())))


def test_products_shuffle_no_points(spark, points):
    """Blocks are read where they meet, not shuffled to each meeting."""
    over = blocked.Blocks.of(cloud(spark, points), 20)
    made = plan(blocked.pairs(over, over))
    assert "CartesianProduct" in made and "Exchange" not in made


def test_asymmetric_edges_in_one_pass(spark):
    """F17."""
    df = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (1, 3, 0.2), (3, 1, 0.4), (4, 1, 0.3), (4, 4, 1.0)], "i long, j long, w double")
    got = checks.asymmetric_edges(df, 0.01)
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert sorted((r["i"], r["j"], r["w"], r["m"]) for r in got.na.fill(-1.0).collect()) == [(1, 3, 0.2, 0.4), (1, 4, -1.0, 0.3), (3, 1, 0.4, 0.2), (4, 1, 0.3, -1.0)]


def test_cutoff_of_whole_clouds_needs_no_order(spark, points):
    """F14."""
    x = cloud(spark, points)
    assert abs(pointcloud.estimate_cutoff(x, 1 << 30, 5, plan="blocks") - pointcloud.estimate_cutoff(x, len(points), 5, plan="full")) < 1e-12
