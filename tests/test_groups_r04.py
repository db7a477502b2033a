"""Findings of round 4: what products and the Lanczos basis shuffle follows the number of points, not of pairs or of products."""

import numpy as np
import pytest

from tideline.operators import blocked, kernels
from tideline.operators.distance import pairwise


def cloud(spark, x):
    return spark.createDataFrame([(i * 3 + 1, r) for i, r in enumerate(np.asarray(x, float).tolist())], "point_id long, x array<double>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(8).normal(size=(110, 3))


def test_tasks_are_pairs_of_groups_however_many_blocks_there_are(spark, points):
    """each task leaves a matrix for each block it meets; their number was that of files squared."""
    few, many = (blocked.Blocks.of(cloud(spark, points), rows) for rows in (22, 3))
    assert many.blocks > 6 * few.blocks and many.groups == few.groups == 5 and many.blocks % many.groups == 0
    vectors = many.ones().selectExpr("block", "v", f"block % {many.groups} AS g")
    made = blocked.meetings(many, many, vectors)
    assert made.rdd.getNumPartitions() == 15 and "Exchange" not in plan(made)
    assert blocked.meetings(few, many, vectors).rdd.getNumPartitions() == 25


def test_products_of_groups_equal_those_of_the_matrix(spark, points):
    x, y = cloud(spark, points), cloud(spark, points[:33] + 0.1)
    kernel, over, new = kernels.gaussian(0.8), blocked.Blocks.of(x, 7), blocked.Blocks.of(y, 7)
    f = np.sin(np.arange(len(points)))
    values = spark.createDataFrame([(i * 3 + 1, float(v)) for i, v in enumerate(f)], "point_id long, f double")
    vectors = over.vectors(values, ["f"])
    for of, at, hollow in ((over, points, False), (over, points, True), (new, points[:33] + 0.1, False)):
        k = np.exp(-pairwise(at, points, "sqeuclidean") / 1.6)
        if hollow:
            np.fill_diagonal(k, 0)
        got = dict(map(tuple, of.frame(blocked.product(kernel, of, over, vectors, 1, hollow=hollow), ["s"]).collect()))
        assert len(got) == len(at) and np.allclose([got[i * 3 + 1] for i in range(len(at))], k @ f)


def test_a_basis_is_not_shuffled(spark, points):
    """all blocks of the basis went through a shuffle two to four times for each product."""
    over = blocked.Blocks.of(cloud(spark, points), 22)
    parts = [(blocked.product(kernels.gaussian(s), over, over, over.ones(), 1), 1) for s in (0.5, 1.0, 2.0)]
    made = blocked.mapped(parts, over.blocks, np.hstack)
    assert "Exchange" not in plan(made) and "SortMergeJoin" in plan(made)
    assert np.allclose(blocked.cross(parts, over.blocks), (m := np.column_stack([np.exp(-pairwise(points, points, "sqeuclidean") / (2 * s)).sum(axis=1) for s in (0.5, 1.0, 2.0)])).T @ m)


def test_eigenvalues_after_parts_of_the_basis_became_one(spark, points):
    x, taken = points[:60], []
    over, kernel = blocked.Blocks.of(cloud(spark, x), 30), kernels.gaussian(0.05)

    def apply(v, width):
        taken.append(width)
        return blocked.product(kernel, over, over, v, width)

    values, vectors = blocked.leading(apply, over, 2, 2)
    assert len(taken) > 9
    want = np.linalg.eigvalsh(np.exp(-pairwise(x, x, "sqeuclidean") / 0.1))[::-1][:2]
    assert np.allclose(values, want, atol=1e-8) and np.allclose(blocked.cross([(vectors, 2)], over.blocks), np.eye(2), atol=1e-8)
