"""Findings of round 4: the registered queries over a cloud of more than 8,192 points, as 0.1 GB has, equal brute force in every row."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tideline import queries

N = 8200


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    draw = np.random.default_rng(11)
    x, label = draw.normal(size=(N, 2)).astype(np.float32), draw.integers(0, 10, N)
    folder = tmp_path_factory.mktemp("large")
    pq.write_table(pa.table({"vec_id": np.arange(N) * 2, "embedding": list(x), "label": label.astype(np.int32)}), folder / "embeddings.parquet")
    return str(folder), x.astype(float), label.astype(float)


def squares(x, size=1000):
    for at in range(0, N, size):
        d2 = np.zeros((min(size, N - at), N))
        for c in x.T:
            gap = c[at : at + size, None] - c
            d2 += gap * gap
        yield d2


def found(spark, name, folder, columns):
    got = queries.QUERIES[name](spark, folder).toPandas().sort_values(columns[0])
    assert np.array_equal(got[columns[0]], np.arange(N) * 2)
    return got[columns[1:]].to_numpy(float)


def extents(spark, name, large, values):
    folder, x, _ = large
    got = found(spark, name, folder, ["i", "n", "total", "least", "most"])
    want = np.vstack([np.column_stack([np.full(len(w), N), w.sum(axis=1), w.min(axis=1), w.max(axis=1)]) for w in map(values, squares(x))])
    assert np.allclose(got, want, rtol=1e-9, atol=6e-5)


def test_gaussian(spark, large):
    """keys of several blocks had two types, and the sort of a pair's points failed."""
    extents(spark, "kern_gaussian", large, lambda d2: np.exp(-d2 / 1.4))


def test_inverse_multiquadric(spark, large):
    """F7."""
    extents(spark, "kern_inverse_multiquadric", large, lambda d2: 1 / np.sqrt(d2 / 1.4 + 1))


def test_inverse_quadratic(spark, large):
    """F8."""
    extents(spark, "kern_inverse_quadratic", large, lambda d2: 1 / (d2 / 1.4 + 1))


def test_multiquadric(spark, large):
    """F9."""
    extents(spark, "kern_multiquadric", large, lambda d2: np.sqrt(d2 / 1.4 + 1))


def test_quintic(spark, large):
    """F10."""
    extents(spark, "kern_quintic", large, lambda d2: np.sqrt(d2) ** 5)


def test_thinplate(spark, large):
    """F11."""
    extents(spark, "kern_thinplate", large, lambda d2: d2 * np.log(np.sqrt(np.where(d2 > 0, d2, 1))))


def test_constant_function_stays_constant(spark, large):
    """F12."""
    assert np.allclose(found(spark, "nystrom_rowsum", large[0], ["point_id", "one"]), 1)


def test_all_distances(spark, large):
    """pairs of blocks leave three numbers a point instead of all pairs, which were grouped by point."""
    made = queries.QUERIES["dist_full"](spark, large[0])
    assert "hashpartitioning(i#" not in made._jdf.queryExecution().executedPlan().toString()
    extents(spark, "dist_full", large, lambda d2: d2)


def test_continuous_neighbours(spark, large):
    """half of the points had no row."""
    folder, x, _ = large
    dk = np.concatenate([np.sqrt(np.partition(d2, 9, axis=1)[:, 9]) for d2 in squares(x)])
    got, want, at = found(spark, "kern_cknn", folder, ["i", "n", "least", "most", "total"]), [], 0
    for d2 in squares(x):
        near = np.sqrt(d2) / np.sqrt(dk[at : at + len(d2), None] * dk) < 0.9
        want += [[len(j), j[0] * 2, j[-1] * 2, j.sum() * 2] for j in map(np.flatnonzero, near)]
        at += len(d2)
    assert np.array_equal(got, np.array(want, float))


def test_first_level_of_a_pyramid(spark, large):
    """half of the points had no row."""
    folder, x, label = large
    want = np.concatenate([(w @ label) / w.sum(axis=1) for w in (np.exp(-d2 / 1.4) for d2 in squares(x))])
    assert np.allclose(found(spark, "lp_level0", folder, ["point_id", "label"])[:, 0], want, atol=6e-7)
