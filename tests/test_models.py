"""Distances, kernels, linear models, manifolds, control and streams against NumPy and closed forms."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.functions import linalg
from tideline.operators import control, distance, dynamics, kernels, manifold, pointcloud, regress
from tideline.operators.collection import Collection, CollectionError
from tideline.plans import edmd, transformers
from tideline.sources import io, systems
from tideline.streaming import online


def cloud(spark, x):
    return spark.createDataFrame(pa.table({"point_id": np.arange(len(x)), "x": [row.tolist() for row in np.asarray(x, float)]}))


def dense(edges, n, m=None, column="d"):
    out = np.full((n, m or n), np.nan)
    for r in edges.collect():
        out[r["i"], r["j"]] = r[column]
    return out


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(1).uniform(size=(60, 2))
    return x, cloud(spark, x)


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine"])
def test_plans_agree(points, metric):
    x, df = points
    want = distance.pairwise(x, x, metric)
    assert np.allclose(dense(distance.full(df, metric=metric), 60), want)
    assert np.allclose(dense(distance.blocks(df, metric=metric, rows=17), 60), want)


def test_range_plans_agree(points):
    x, df = points
    want = np.where(distance.pairwise(x, x, "euclidean") <= 0.2, distance.pairwise(x, x, "euclidean"), np.nan)
    for plan in ("full", "grid", "blocks"):
        assert np.allclose(dense(distance.distances(df, cut_off=0.2, plan=plan, dimensions=2), 60), want, equal_nan=True)


def test_knn_counts_the_point_itself(points):
    x, df = points
    want = np.sort(distance.pairwise(x, x, "euclidean"), axis=1)[:, :5]
    for plan in ("full", "blocks"):
        got = distance.distances(df, k=5, plan=plan)
        assert np.allclose(np.sort(np.nan_to_num(dense(got, 60), nan=9), axis=1)[:, :5], want)
    assert distance.distances(df, cut_off=1e-9, kmin=3, plan="full").groupBy("i").count().where("count < 3").isEmpty()


def test_kernels_of_zero_and_one(spark):
    df = cloud(spark, [[0.0], [1.0]])
    for name, want in {"gaussian": np.exp(-0.5), "multiquadric": np.sqrt(1.5), "inverse_multiquadric": 1 / np.sqrt(1.5), "inverse_quadratic": 1 / 1.5, "thinplate": 0.0, "cubic": 1.0, "quintic": 1.0}.items():
        assert dense(kernels.BY_NAME[name]()(df), 2, column="w")[0, 1] == pytest.approx(want)
    assert dense(kernels.thinplate()(df), 2, column="w")[0, 0] == 0


def test_normalisations(points):
    x, df = points
    k = np.exp(-distance.pairwise(x, x, "sqeuclidean") / 0.2)
    edges = kernels.gaussian(0.1)(df)
    q = k.sum(axis=1)
    w = k / np.outer(q, q)
    assert np.allclose(dense(kernels.density_normalized(edges)[0], 60, column="w"), w)
    assert np.allclose(dense(kernels.stochastic(edges), 60, column="w"), k / q[:, None])
    s = np.sqrt(w.sum(axis=1))
    assert np.allclose(dense(kernels.diffusion(edges)[0], 60, column="w"), w / np.outer(s, s))


def test_continuous_knn(points):
    x, df = points
    d = distance.pairwise(x, x, "euclidean")
    dk = np.sort(d, axis=1)[:, 4]
    want = {(i, j) for i in range(60) for j in range(60) if d[i, j] / np.sqrt(dk[i] * dk[j]) < 1.5}
    assert {(r["i"], r["j"]) for r in kernels.continuous_knn(distance.distances(df), 5, 1.5).collect()} == want


def test_cutoff_and_outliers(points):
    x, df = points
    d = distance.pairwise(x, x, "euclidean")
    assert pointcloud.estimate_cutoff(df, 1000, 10) == pytest.approx(np.sort(d, axis=1)[:, 9].max())
    want = {i for i in range(60) if (d[i] <= 0.1).sum() - 1 >= 2}
    assert {r["point_id"] for r in pointcloud.remove_outliers(df, 2, 0.1, dimensions=2).collect()} == want


def test_linalg():
    draw = np.random.default_rng(3)
    a = draw.normal(size=(4, 4))
    values, vectors = np.linalg.eig(a)
    assert np.allclose(linalg.expm(a), (vectors * np.exp(values)) @ np.linalg.inv(vectors))
    s = a @ a.T + np.eye(4)
    assert np.allclose(linalg.expm(linalg.logm(s)), s) and np.allclose(linalg.matrix_power(linalg.matrix_power(s, 0.5), 2), s)
    b, q, r = draw.normal(size=(4, 2)), np.eye(4), np.eye(2)
    p = linalg.dare(a, b, q, r)
    assert np.allclose(p, a.T @ p @ a - a.T @ p @ b @ np.linalg.solve(r + b.T @ p @ b, b.T @ p @ a) + q)
    with pytest.raises(linalg.NumericalError):
        linalg.logm(np.array([[1.0, 1.0], [0.0, 1.0]]))
    h, c = np.diag([2.0, 2.0]), np.array([-6.0, 2.0])
    assert np.allclose(linalg.box_qp(h, c, np.zeros(2), np.full(2, 2.0)), [2.0, 0.0], atol=1e-6)
    assert np.allclose(linalg.box_qp(h, c, np.full(2, -9.0), np.full(2, 9.0), np.array([[1.0, 1.0]]), np.array([1.0])), [2.5, -1.5], atol=1e-5)


def linear_data(spark, a, n=5, steps=12, seed=2, control_matrix=None):
    draw = np.random.default_rng(seed)
    states, inputs = [], []
    for _ in range(n):
        x, rows, us = draw.normal(size=len(a)), [], []
        for _ in range(steps):
            rows.append(x)
            u = draw.normal(size=1)
            us.append(u)
            x = a @ x + (control_matrix @ u if control_matrix is not None else 0)
        states.append(rows)
        inputs.append(us[:-1])
    return io.from_tensor(spark, np.array(states)), io.from_tensor(spark, np.array(inputs), ["u0"])


A = np.array([[0.9, 0.2], [-0.1, 0.8]])


@pytest.mark.parametrize("how", [dict(mode="matrix"), dict(mode="spectral"), dict(rank=2), dict(rank=2, project=True), dict(residual=1e-6)])
def test_dmd_finds_the_matrix_and_reconstructs(spark, how):
    tsc, _ = linear_data(spark, A)
    model = dynamics.Dmd(**how).fit(tsc)
    assert np.allclose(np.sort_complex(model.eigenvalues), np.sort_complex(np.linalg.eigvals(A)))
    assert model.score(tsc) > -1e-8
    half = model.predict(tsc.initial_states(1), [0.0, 0.5, 1.0]).df.where("id = 0").orderBy("time").collect()
    first = tsc.df.where("id = 0 AND time = 0").first()
    assert np.allclose([half[1]["feature0"], half[1]["feature1"]], linalg.matrix_power(A, 0.5).real @ [first["feature0"], first["feature1"]])


def test_generator_and_flowmap_agree(spark):
    tsc, _ = linear_data(spark, A)
    g = dynamics.Dmd(mode="matrix", generator=True).fit(tsc)
    assert np.allclose(linalg.expm(g.system.matrix), A)


def test_generator_from_differences(spark):
    g = np.array([[-0.1, 1.0], [-1.0, -0.1]])
    t = np.arange(200) * 0.01
    tsc = io.from_array(spark, np.array([linalg.expm(g * v) @ [1.0, 0.5] for v in t]), t)
    assert np.allclose(dynamics.GeneratorDmd(accuracy=4).fit(tsc, delta=0.01).system.matrix, g, atol=1e-5)


def test_controlled_and_affine(spark):
    b = np.array([[0.3], [1.0]])
    tsc, u = linear_data(spark, A, control_matrix=b)
    model = dynamics.ControlDmd().fit(tsc, u)
    assert np.allclose(model.system.matrix, A) and np.allclose(model.system.control, b)
    assert model.score(tsc, u) > -1e-8
    with pytest.raises(CollectionError):
        model.system.evolve(np.ones(2), np.array([0.0, 0.5]), np.ones((1, 1)))
    affine = dynamics.LinearSystem(np.array([[-1.0]]), "differential", control=np.array([[[0.5]]]), affine=True)
    assert affine.evolve(np.array([2.0]), np.array([0.0, 1.0]), np.array([[1.0]]))[-1] == pytest.approx(2 * np.exp(-0.5))
    forced = dynamics.LinearSystem(np.array([[-1.0]]), "differential", control=np.array([[1.0]]))
    assert forced.evolve(np.array([0.0]), np.array([0.0, 1.0]), np.array([[1.0]]))[-1] == pytest.approx(1 - np.exp(-1))


def test_qois_keep_their_names(spark):
    tsc, _ = linear_data(spark, A)
    model = dynamics.Dmd().fit(tsc)
    both = model.predict(tsc.initial_states(1), [1.0]).df.first()
    turned = model.predict(tsc.initial_states(1), [1.0], qois=["feature1", "feature0"]).df.where(F.col("id") == both["id"]).first()
    assert (turned["feature0"], turned["feature1"]) == pytest.approx((both["feature0"], both["feature1"]))


def test_edmd_of_a_sine(spark):
    t = np.linspace(0, 2 * np.pi, 60)
    tsc = Collection.of(spark.createDataFrame([(0, k, float(np.sin(v) + 10)) for k, v in enumerate(t)], "id long, time long, sin double"))
    for model in (edmd.Edmd([transformers.Identity(const=True), transformers.Takens(3)]), edmd.Edmd([transformers.Identity(const=True), transformers.Takens(3)], stepwise=True)):
        assert model.fit(tsc).n_samples_ic == 4
        assert model.score(tsc) > -1e-4
    assert len(model[:1].steps) == 1 and set(model.ranked_triplets(tsc)) == set(range(len(model.eigenvalues)))
    part = edmd.Edmd([transformers.Takens(1)], dynamics.Dmd(mode="matrix"))
    whole = edmd.Edmd([transformers.Takens(1)], dynamics.Dmd(mode="matrix")).fit(tsc)
    assert np.allclose(part.partial_fit(tsc).model.system.matrix, whole.model.system.matrix)
    with pytest.raises(CollectionError):
        whole.predict(tsc.initial_states(1))


def test_stepwise_prediction_with_control(spark):
    """Stepwise and plain prediction agree for a linear system with control; the plan of a step reads two folders at most."""
    draw = np.random.default_rng(1)
    rows, x = [], np.zeros(4)
    for k in range(12):
        u = draw.normal(size=4)
        rows += [(i, k, float(x[i]), float(u[i])) for i in range(4)]
        x = 0.8 * x + 0.5 * u + 0.1
    df = spark.createDataFrame(rows, "id long, time long, x double, u double")
    state, control = Collection.of(df, features=["x"]), Collection.of(df, features=["u"])
    made = []
    for stepwise in (False, True):
        model = edmd.Edmd([transformers.Identity(const=True)], dynamics.ControlDmd(), stepwise=stepwise).fit(state, control.drop_last(1))
        made.append(model.reconstruct(state, control).df.orderBy("id", "time").toPandas())
    want = state.df.orderBy("id", "time").toPandas()
    assert all(np.allclose(m[["time", "x"]], want[["time", "x"]], atol=1e-6) for m in made)


def test_controls_need_the_keys_of_the_states(spark):
    df = spark.createDataFrame([(0, k, float(k % 3), 1.0) for k in range(8)], "id long, time long, x double, u double")
    state, control = Collection.of(df, features=["x"]), Collection.of(df.where("time <> 3"), features=["u"])
    for model in (dynamics.ControlDmd(), dynamics.AffineDmd()):
        with pytest.raises(CollectionError):
            model.fit(state, control, delta=1.0)


def test_box_programme_that_does_not_end_is_an_error():
    with pytest.raises(linalg.NumericalError):
        linalg.box_qp(np.array([[2.0, 0.3], [0.3, 5.0]]), np.array([-7.0, 3.0]), np.full(2, -9.0), np.full(2, 9.0), rounds=3)


def test_bandwidths_need_a_negative_coefficient(spark):
    with pytest.raises(ValueError):
        kernels.variable_bandwidth(cloud(spark, np.zeros((3, 1))), 1.0, 2, 1.0, 0.5)


def test_grid_search(spark):
    tsc, _ = linear_data(spark, A, n=4)
    best, value, tried = edmd.grid_search(lambda rank: edmd.Edmd([], dynamics.Dmd(rank=rank)), {"rank": [1, 2]}, tsc, {"kind": "series", "k": 2}, workers=2)
    assert best == {"rank": 2} and len(tried) == 2 and value > -1e-6


def test_diffusion_map_and_its_extension(spark):
    t = np.linspace(0, 2 * np.pi, 80, endpoint=False)
    df = cloud(spark, np.column_stack([np.cos(t), np.sin(t)]))
    model = manifold.DiffusionMap(kernels.gaussian(0.05), 5).fit(df)
    assert model.values[0] == pytest.approx(1) and np.allclose(model.values[1], model.values[2])
    inside = model.transform(df).orderBy("point_id").toPandas().iloc[:, 1:].to_numpy()
    assert np.allclose(inside, model.vectors, atol=1e-8)
    back = model.vectors @ model.inverse_map().T
    assert np.allclose(back, np.column_stack([np.cos(t), np.sin(t)]), atol=1e-6)
    marks = manifold.LandmarkMap(kernels.gaussian(0.05), 3, 40).fit(df)
    assert marks.values[0] == pytest.approx(1) and marks.embedding().count() == 80
    variable = manifold.VariableMap(0.05, 4, k=5).fit(df)
    assert variable.embedding().count() == 80


def test_local_regression_finds_the_repeated_coordinate():
    t = np.linspace(0, 1, 150)
    vectors = np.column_stack([np.ones(150), np.cos(np.pi * t), np.cos(2 * np.pi * t)])
    r = manifold.local_regression_residuals(vectors)
    assert np.isnan(r[0]) and r[1] == 1 and r[2] < 0.2
    assert manifold.select_coordinates(r, threshold=0.5) == [1]


def test_jointly_smooth_functions(spark):
    draw = np.random.default_rng(4)
    common = draw.uniform(size=80)
    x = np.column_stack([common, draw.uniform(size=80), common**2, draw.uniform(size=80)])
    model = manifold.JointlySmooth([("a", kernels.gaussian(0.02), [0, 1]), ("b", kernels.gaussian(0.02), [2, 3])], 15, 3).fit(cloud(spark, x))
    assert abs(model.functions[:, 0].std()) < 0.02 or abs(np.corrcoef(model.functions[:, 1], common)[0, 1]) > 0.5
    assert model.transform(cloud(spark, x[:5])).count() == 5 and 1 < model.noise_level(3) < 2


def test_interpolators(spark):
    t = np.linspace(0, 1, 60)
    x, f = cloud(spark, t[:, None]), np.sin(4 * t)
    values = spark.createDataFrame(pa.table({"point_id": np.arange(60), "f": f}))
    gh = regress.GeometricHarmonics(kernels.gaussian(0.01), 12).fit(x, values, ["f"])
    assert gh.score(x, values) > -0.02
    lp = regress.LaplacianPyramid(epsilon=1.0, auto=True, most=6).fit(x, values, "f")
    got = lp.predict(x).orderBy("point_id").toPandas()["f"].to_numpy()
    assert np.abs(got - f)[3:-3].max() < 0.25


def test_regulator_and_predictive_control(spark):
    system = dynamics.LinearSystem(np.array([[1.0, 0.1], [0.0, 1.0]]), control=np.array([[0.0], [0.1]]))
    f = control.Regulator(system, 1.0, 0.1)
    assert np.abs(np.linalg.eigvals(system.matrix - system.control @ f.gain)).max() < 1
    plan = control.Predictive(system, 10, np.array([[-2.0, 2.0]]), output=np.array([[1.0, 0.0]]))
    states, inputs = plan.closed_loop(lambda x, u: system.matrix @ x + system.control @ u, np.zeros(2), np.array([1.0]), 60)
    assert np.abs(inputs).max() <= 2 + 1e-9 and abs(states[-1][0] - 1) < 0.1
    start = io.initial_condition(spark, np.array([[0.0, 0.0], [0.5, 0.0]]), names=["a", "b"])
    got = plan.plan_all(start, np.array([1.0])).where("id = 1").orderBy("step").toPandas()["u0"].to_numpy()
    assert np.allclose(got, plan.plan(np.array([0.5, 0.0]), np.array([1.0])).ravel(), atol=1e-6)


def test_simulated_systems(spark):
    tsc = systems.simulate(spark, systems.pendulum, np.array([[0.01, 0.0]]), np.linspace(0, 1, 11))
    last = tsc.df.orderBy(F.desc("time")).first()
    assert last["x0"] == pytest.approx(0.01 * np.cos(np.sqrt(9.81)), abs=1e-5)
    for f, n, m in ((systems.hopf, 2, 0), (systems.lorenz, 3, 0), (systems.duffing, 2, 0), (systems.van_der_pol, 2, 1), (systems.inverted_pendulum, 4, 1), (systems.dc_motor, 2, 1), (systems.burger, 8, 0), (systems.three_stable_points, 2, 0)):
        assert np.isfinite(f(0.0, np.full(n, 0.1), np.full(m, 0.1))).all()


def test_online_models_equal_batch(spark):
    tsc, _ = linear_data(spark, A)
    model = online.OnlineDmd().partial_fit(tsc)
    assert np.allclose(model.system.matrix, A, atol=1e-6)
    state = online.GramState(list(tsc.features))
    for part in ("id < 2", "id >= 2"):
        state.add(tsc.with_df(tsc.df.where(part)))
    assert np.allclose(state.model(mode="matrix").system.matrix, dynamics.Dmd(mode="matrix").fit(tsc).system.matrix)
    stream = online.StreamingDmd(rank=2)
    draw = np.random.default_rng(1)
    lift = draw.normal(size=(20, 2))
    for _ in range(40):
        x = draw.normal(size=2)
        stream.update(lift @ x, lift @ (A @ x))
    assert np.allclose(np.sort_complex(stream.modes()[0]), np.sort_complex(np.linalg.eigvals(A)))


def test_forgetting(spark):
    rls = online.Recursive(1, 0.5)
    x = np.random.default_rng(2).normal(size=(60, 1))
    rls.batch(x[:30], 2 * x[:30])
    for v in x[30:]:
        rls.update(v, 3 * v)
    assert rls.ready and rls.a[0, 0] == pytest.approx(3, abs=1e-6)


def test_batch_sink_skips_replays(spark):
    tsc, _ = linear_data(spark, A, n=2)
    sink = online.BatchSink(list(tsc.features))
    for number in (0, 1, 1):
        sink(tsc.df.where(F.col("id") == number), number)
    assert sink.state.n == 22 and np.allclose(sink.state.model(mode="matrix").system.matrix, A)


def test_batch_sink_goes_on_after_a_restart(spark, tmp_path):
    tsc, _ = linear_data(spark, A, n=3)
    for number, whole in ((0, 11), (1, 22), (1, 22), (2, 33)):
        sink = online.BatchSink(list(tsc.features), path=f"file://{tmp_path}/state")
        sink(tsc.df.where(F.col("id") == number), number)
        assert sink.state.n == whole
    assert np.allclose(sink.state.model(mode="matrix").system.matrix, A)


def test_weighted_batches_equal_the_recursion(spark):
    tsc, _ = linear_data(spark, A, n=3)
    model, by_row = online.OnlineDmd(weight=0.9), online.Recursive(2, 0.9)
    for k in range(3):
        part = tsc.with_df(tsc.df.where(F.col("id") == k))
        model.partial_fit(part)
        rows = part.df.orderBy("time").select(*tsc.features).toPandas().to_numpy()
        by_row.batch(rows[:-1], rows[1:])
    assert np.allclose(model.state.g, by_row.g) and np.allclose(model.state.h, by_row.h) and model.state.seen == by_row.seen


def test_stream_of_keys(spark, tmp_path):
    tsc, _ = linear_data(spark, A, n=3)
    for k, part in enumerate(("time < 6", "time >= 6")):
        tsc.df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(tsc.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = online.online_by_key(source, "id", "time", list(tsc.features))
    run = out.writeStream.format("memory").queryName("models").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = spark.sql("SELECT * FROM models").orderBy(F.desc("seen")).limit(3).collect()
    assert {r["id"] for r in last} == {0, 1, 2}
    assert all(np.allclose(np.array(r["a"]).reshape(2, 2), A, atol=1e-6) for r in last if r["seen"] == 11)


def test_landmark_share_is_bounded_by_a_number(spark, monkeypatch):
    t = np.linspace(0, 2 * np.pi, 80, endpoint=False)
    df = cloud(spark, np.column_stack([np.cos(t), np.sin(t)]))
    monkeypatch.setattr(manifold, "LARGEST", 16)
    marks = manifold.LandmarkMap(kernels.gaussian(0.05), 3, 0.25).fit(df)
    assert len(marks.mark_ids) == 16 and marks.embedding().count() == 80
