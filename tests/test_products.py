"""Kernel products, eigenvectors by Lanczos, pivot cells, folds by shared sums, keys of controls: against dense or plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import blocked, distance, dynamics, kernels, manifold, regress, voronoi
from tideline.operators.collection import Collection, CollectionError
from tideline.plans import edmd, transformers


def cloud(spark, x):
    return spark.createDataFrame([(i * 3 + 1, r) for i, r in enumerate(np.asarray(x, float).tolist())], "point_id long, x array<double>")


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(8).uniform(size=(420, 3))


def kernel_matrix(x, y, epsilon):
    return np.exp(-((x[:, None] - y[None]) ** 2).sum(axis=2) / (2 * epsilon))


def columns(frame):
    return frame.orderBy("point_id").toPandas().iloc[:, 1:].to_numpy()


def test_products_equal_dense_ones(spark, points):
    x, y = points[:230], points[230:300]
    a, b = blocked.Blocks.of(cloud(spark, x), 60), blocked.Blocks.of(cloud(spark, y), 60)
    assert a.blocks == 4 and a.n == 230
    v = np.column_stack([np.arange(230.0), np.cos(np.arange(230))])
    table = spark.createDataFrame([(i * 3 + 1, float(p), float(q)) for i, (p, q) in enumerate(v)] + [(5, 1.0, 1.0)], "point_id long, p double, q double")
    vectors = a.vectors(table, ["p", "q"])
    assert np.allclose(columns(a.frame(vectors, ["p", "q"])), v)
    for k, dense in ((kernels.gaussian(0.1), lambda d2: np.exp(-d2 / 0.2)), (kernels.cubic(), lambda d2: d2**1.5), (kernels.inverse_quadratic(0.5), lambda d2: 1 / (d2 + 1))):
        within, to = dense(((x[:, None] - x[None]) ** 2).sum(axis=2)), dense(((y[:, None] - x[None]) ** 2).sum(axis=2))
        assert np.allclose(columns(a.frame(blocked.product(k, a, a, vectors, 2), ["p", "q"])), within @ v)
        assert np.allclose(columns(b.frame(blocked.product(k, b, a, vectors, 2), ["p", "q"])), to @ v)
    near = kernel_matrix(x, x, 0.1) * (((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.04)
    assert np.allclose(columns(a.frame(blocked.product(kernels.gaussian(0.1), a, a, vectors, 2, cut_off=0.2), ["p", "q"])), near @ v)


@pytest.mark.parametrize("scale", [None, "stochastic", "density", "conjugate"])
def test_moments_equal_sums_over_edges(spark, points, scale):
    x = points[:150]
    w = kernel_matrix(x, x, 0.1)
    q = w.sum(axis=1)
    w = {None: w, "stochastic": w / q[:, None], "density": w / np.outer(q, q), "conjugate": w / np.sqrt(np.outer(q, q))}[scale]
    got = columns(blocked.moments(kernels.gaussian(0.1), blocked.Blocks.of(cloud(spark, x), 50), scale=scale))
    assert np.allclose(got, np.column_stack([w.sum(axis=1), (w * w).sum(axis=1)]))


def test_eigenvectors_of_many_blocks_equal_those_of_one(spark, points):
    df = cloud(spark, points)
    one, many = (manifold.DiffusionMap(kernels.gaussian(0.05), 6, rows=rows).fit(df) for rows in (1000, 90))
    assert one.over.blocks == 1 and many.over.blocks == 5
    k = kernel_matrix(points, points, 0.05)
    k /= np.outer(k.sum(axis=1), k.sum(axis=1))
    r = k.sum(axis=1)
    exact = np.linalg.eigvalsh(k / np.sqrt(np.outer(r, r)))[::-1][:6]
    for model in (one, many):
        assert np.allclose(model.values, exact, atol=1e-9)
        v = model.vectors
        assert np.allclose((k / r[:, None]) @ v, v * model.values, atol=1e-5)
        assert np.allclose(columns(model.transform(df)), v, atol=1e-4)
    assert np.allclose(np.abs((one.vectors * many.vectors).sum(axis=0)), 1, atol=1e-5)


def test_lanczos_uses_up_small_spaces(spark):
    x = np.random.default_rng(1).normal(size=(30, 2))
    over = blocked.Blocks.of(cloud(spark, x), 8)
    values, vectors = blocked.leading(blocked.scaled_operator(kernels.gaussian(1.0), over, None), over, 30, 7)
    assert np.allclose(values, np.linalg.eigvalsh(kernel_matrix(x, x, 1.0))[::-1], atol=1e-8)
    constant = blocked.Blocks.of(cloud(spark, np.zeros((20, 2))), 8)
    values, _ = blocked.leading(blocked.scaled_operator(kernels.gaussian(1.0), constant, None), constant, 1, 4)
    assert values[0] == pytest.approx(20)


@pytest.mark.parametrize("alpha", [0.0, 1.0])
def test_landmark_maps_equal_dense_singular_values(spark, points, alpha):
    df = cloud(spark, points)
    marks = df.where("point_id % 4 = 1")
    model = manifold.LandmarkMap(kernels.gaussian(0.05), 4, marks, alpha=alpha, rows=100).fit(df)
    at = [i for i in range(len(points)) if (i * 3 + 1) % 4 == 1]
    w = kernel_matrix(points, points[at], 0.05)
    if alpha:
        w /= (w @ w.sum(axis=0))[:, None]
    s = 1 / np.sqrt(w @ w.sum(axis=0))
    u, values, _ = np.linalg.svd(w * s[:, None], full_matrices=False)
    assert np.allclose(model.values, values[:4], atol=1e-9)
    got = columns(model.embedding())
    assert np.allclose(np.abs(got), np.abs(s[:, None] * u[:, :4]), atol=1e-5)
    assert np.allclose(columns(model.transform(df)), got, atol=1e-8)
    sums = columns(manifold.landmark_moments(kernels.gaussian(0.05), df, marks, alpha, rows=100))
    assert np.allclose(sums, np.column_stack([(w * s[:, None]).sum(axis=1), ((w * s[:, None]) ** 2).sum(axis=1)]))


@pytest.mark.parametrize("stochastic", [False, True])
def test_harmonics_equal_dense_ones(spark, points, stochastic):
    x, y = points[:200], points[200:230]
    f = np.sin(4 * x[:, 0]) + x[:, 1]
    df, new = cloud(spark, x), cloud(spark, y)
    values = spark.createDataFrame([(i * 3 + 1, float(v)) for i, v in enumerate(f)] + [(2, 9.0)], "point_id long, f double")
    got = columns(regress.GeometricHarmonics(kernels.gaussian(0.05), 8, stochastic, rows=60).fit(df, values, ["f"]).predict(new))[:, 0]
    k, to = kernel_matrix(x, x, 0.05), kernel_matrix(y, x, 0.05)
    if stochastic:
        q = k.sum(axis=1)
        k, to = k / np.outer(q, q), to / q
        r = k.sum(axis=1)
        lam, v = np.linalg.eigh(k / np.sqrt(np.outer(r, r)))
        lam, v, to = lam[::-1][:8], (v / np.sqrt(r)[:, None])[:, ::-1][:, :8], to / to.sum(axis=1, keepdims=True)
        weights = v @ (np.linalg.lstsq(v, f, rcond=None)[0] / lam)
    else:
        lam, v = np.linalg.eigh(k)
        lam, v = lam[::-1][:8], v[:, ::-1][:, :8]
        weights = v @ (v.T @ f / lam)
    assert np.allclose(got, to @ weights, atol=1e-5)
    with pytest.raises(ValueError):
        regress.GeometricHarmonics(kernels.gaussian(0.05), 8).fit(df, values.where("point_id > 1"), ["f"])


@pytest.mark.parametrize("parts", [2, 3])
def test_joint_functions_equal_dense_ones(spark, parts):
    draw = np.random.default_rng(4)
    common = draw.uniform(size=160)
    x = np.column_stack([c for _ in range(parts) for c in (common + 0.05 * draw.normal(size=160), draw.uniform(size=160))])
    named = [(str(p), kernels.gaussian(0.02), [2 * p, 2 * p + 1]) for p in range(parts)]
    model = manifold.JointlySmooth(named, 10, 3, rows=60).fit(cloud(spark, x))
    bases = []
    for p in range(parts):
        k = kernel_matrix(x[:, 2 * p : 2 * p + 2], x[:, 2 * p : 2 * p + 2], 0.02)
        k /= np.outer(k.sum(axis=1), k.sum(axis=1))
        r = k.sum(axis=1)
        v = np.linalg.eigh(k / np.sqrt(np.outer(r, r)))[1][:, ::-1][:, :10] / np.sqrt(r)[:, None]
        bases.append(np.linalg.qr(v)[0])
    u, s, _ = np.linalg.svd(np.column_stack(bases), full_matrices=False)
    assert np.allclose(model.values, s[:3], atol=1e-5)
    assert np.allclose(np.abs((model.functions / np.linalg.norm(model.functions, axis=0) * u[:, :3]).sum(axis=0)), 1, atol=1e-3)
    assert model.transform(cloud(spark, x[:5])).count() == 5


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cityblock", "chebyshev"])
def test_pivot_cells_equal_all_pairs(spark, metric):
    draw = np.random.default_rng(2)
    x = np.vstack([draw.normal(size=(300, 6)).round(1), np.zeros((120, 6)), draw.normal(size=(80, 6)) * 0.1 + 5])
    y = draw.normal(size=(60, 6)).round(1)
    xs, ys = cloud(spark, x), cloud(spark, y)
    for queries, limit, k in ((None, 0.7, None), (None, None, 4), (ys, None, 7), (ys, 1.5, 3)):
        want = distance.full(xs, queries, metric, limit)
        want = want if k is None else distance.nearest(want, k)
        got = voronoi.near(xs, queries, metric, limit, k, pivots=9, rows=32)
        assert sorted((r["i"], r["j"], round(r["d"], 9)) for r in got.edges.collect()) == sorted((r["i"], r["j"], round(r["d"], 9)) for r in want.collect())
    far = voronoi.near(xs, None, metric, 0.2, pivots=16)
    assert far.share < 0.9 and voronoi.near(xs.limit(0), None, metric, 0.2).edges.count() == 0


def test_controls_are_met_by_key(spark):
    state = Collection.of(spark.createDataFrame([(0, k, float(k * k % 7)) for k in range(5)], "id long, time long, x double"))
    control = lambda times: Collection.of(spark.createDataFrame([(0, k, 1.0 + k) for k in times], "id long, time long, u double"))
    for model in (dynamics.ControlDmd, dynamics.AffineDmd):
        for times in ([0, 0, 1, 2], [0, 1, 3, 4], [0, 1, 2, 3, 3], [0, 1, 2, 3, 4, 9]):
            with pytest.raises(CollectionError):
                model().fit(state, control(times), delta=1.0)
    dynamics.ControlDmd().fit(state, control([0, 1, 2, 3]), delta=1.0)
    dynamics.ControlDmd().fit(state, control([0, 1, 2, 3, 4]), delta=1.0)


def test_predictions_keep_missing_values_and_many_times(spark):
    df = spark.createDataFrame([(0, 5, 1.0, 2.0), (1, 7, None, 1.0)], "id long, time long, a double, b double")
    m = np.array([[0.5, 0.1], [0.0, 0.9]])
    got = dynamics.predict_frame(dynamics.LinearSystem(m), Collection.of(df), [float(k) for k in range(3000)]).orderBy("id", "time").collect()
    assert len(got) == 6000 and (got[2]["time"], got[2]["a"], got[2]["b"]) == pytest.approx((7.0, *(m @ m @ [1, 2])))
    assert got[3000]["a"] is None and got[3000]["time"] == 7.0
    with pytest.raises(CollectionError):
        dynamics.predict_frame(dynamics.LinearSystem(m), Collection.of(df), [0.0, float("nan")])


def test_folds_by_shared_sums_equal_fits_of_each_split(spark):
    draw = np.random.default_rng(3)
    rows = [(i, k, float(v)) for i in range(7) for k, v in enumerate(np.cumsum(draw.normal(size=6 + i)))]
    tsc = Collection.of(spark.createDataFrame(rows, "id long, time long, x double"))
    build = lambda delays, **how: edmd.Edmd([transformers.Takens(delays)], dynamics.Dmd(mode="matrix"), **how)
    split = {"kind": "series", "k": 3}
    found = edmd.grid_search(build, {"delays": [1, 2]}, tsc, split, refit=True)
    assert build(1).additive
    for (parameters, score) in found.tried:
        plain = [build(**parameters).fit(train).score(test) for train, test in edmd.splits(tsc, **split)]
        assert score == pytest.approx(np.mean(plain))
    best, score, tried = found
    assert best == max(tried, key=lambda t: t[1])[0] and np.allclose(found.model.model.system.matrix, build(**best).fit(tsc).model.system.matrix)


def test_failing_candidates(spark):
    tsc = Collection.of(spark.createDataFrame([(i, k, float(k + i)) for i in range(4) for k in range(5)], "id long, time long, x double"))
    build = lambda delays: edmd.Edmd([transformers.Takens(delays)], dynamics.Dmd(mode="matrix"))
    found = edmd.grid_search(build, {"delays": [1, 40]}, tsc, {"kind": "series", "k": 2}, error_score=float("nan"))
    assert found.best == {"delays": 1} and np.isnan(found.tried[1][1])
    with pytest.raises(Exception):
        edmd.grid_search(build, {"delays": [40]}, tsc, {"kind": "series", "k": 2})
