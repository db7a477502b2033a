"""Findings of round 5."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tideline.operators import blocked, distance, pointcloud, voronoi


def cloud(spark, x):
    return spark.createDataFrame([(i * 3 + 1, r) for i, r in enumerate(np.asarray(x, float).tolist())], "point_id long, x array<double>")


def pairs_of(df):
    return sorted((r["i"], r["j"], round(r["d"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def crowd():
    """Points on few places, many of them on one."""
    at = np.random.default_rng(5).integers(0, 12, (150, 2)) / 2
    return np.vstack([at, at[:40], np.tile(at[3], (300, 1))])


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "chebyshev"])
def test_equal_points_meet_others_once(spark, crowd, metric):
    """a distance is worked out for each pair of places, not for each pair of points."""
    x, y = cloud(spark, crowd), cloud(spark, crowd[:60] + 0.25)
    made = distance.grid(x, metric=metric, cut_off=0.6)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(js") < plan.index("aggregate(") < plan.index("collect_list(")
    assert pairs_of(made) == pairs_of(distance.full(x, metric=metric, cut_off=0.6))
    assert pairs_of(distance.grid(x, y, metric=metric, cut_off=0.6)) == pairs_of(distance.full(x, y, metric=metric, cut_off=0.6))


def wanted(name, d):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet/*.parquet'")
    return sorted(db.sql(entry.oracle_sql()[name]).fetchall())


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Parts three times with other keys."""
    d = str(tmp_path_factory.mktemp("repeated"))
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.crossJoin(spark.range(3)).selectExpr("p_partkey + 100000 * id AS p_partkey", "p_size", "p_retailprice").write.parquet(f"{d}/part.parquet")
    return d


def test_edges_are_checked_by_place(spark, repeated, monkeypatch):
    """three equal points have one row of edges, and count as three."""
    seen, write = [], entry.own.written
    monkeypatch.setattr(entry.own, "written", lambda df, name, by=None: seen.append((name, write(df, name, by))) or seen[-1][1])
    got = entry.queries()["val_edges"](spark, repeated).collect()
    assert sorted(map(tuple, got)) == wanted("val_edges", repeated)
    places = spark.read.parquet(f"{repeated}/part.parquet").select("p_size", "p_retailprice").distinct().count()
    assert all(df.select("i").distinct().count() <= places for name, df in seen if name == "edges")


@pytest.mark.parametrize("kmin", [0, 1, 3, 30])
def test_crowded_cells_are_counted(spark, crowd, kmin, monkeypatch):
    """points of a full cell stay without meeting any other."""
    apart = np.vstack([crowd, crowd[:5] + [40, 40], [[90, 90], [90.2, 90], [90.4, 90.1], [90.7, 90], [np.nan, 1]]])
    x, asked, join = cloud(spark, apart), [], distance.grid
    monkeypatch.setattr(pointcloud, "grid", lambda x, y, **how: asked.append(y.count()) or join(x, y, **how))
    near = distance.full(x, cut_off=0.75).where("i <> j").groupBy("i").count().where(f"count >= {kmin}")
    got = sorted(r[0] for r in pointcloud.remove_outliers(x, kmin, 0.75, dimensions=2).select("point_id").collect())
    assert got == sorted(r["i"] for r in near.collect())
    assert asked[0] < len(apart) - 300
    shorter = x.select("point_id", F.concat("x", F.array((F.col("point_id") % 2).cast("double"))).alias("x"))
    near = distance.full(shorter, cut_off=0.75).where("i <> j").groupBy("i").count().where(f"count >= {kmin}")
    got = sorted(r[0] for r in pointcloud.remove_outliers(shorter, kmin, 0.75, dimensions=2).select("point_id").collect())
    assert got == sorted(r["i"] for r in near.collect())


@pytest.fixture(scope="module")
def wide():
    x = np.random.default_rng(6).normal(size=(120, 6)).round(1)
    return np.vstack([x, x[:9]])


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cityblock"])
def test_near_and_nearest_in_one_pass(spark, wide, metric):
    """pairs within the cut-off aren't shuffled."""
    x, y = cloud(spark, wide), cloud(spark, wide[:30] + 0.1)
    for asked in (None, y):
        got = distance.near_and_nearest(x, asked, metric, 1.2, 3, rows=20)
        want = distance.at_least(x, 3, distance.full(x, asked, metric, 1.2), metric, asked)
        assert pairs_of(got) == pairs_of(want)
    assert pairs_of(distance.distances(x, metric=metric, cut_off=1.2, kmin=3, plan="blocks")) == pairs_of(distance.distances(x, metric=metric, cut_off=1.2, kmin=3, plan="full"))


def test_cells_that_exclude_nothing_send_no_copies(spark, monkeypatch):
    """where a reference would go to most cells, blocks meet instead."""
    x = cloud(spark, np.random.default_rng(7).normal(size=(450, 6)))
    monkeypatch.setattr(voronoi, "MANY", 10)
    for k, cut_off in ((None, 6.0), (4, None), (4, 6.0)):
        found = voronoi.near(x, cut_off=cut_off, k=k, pivots=32)
        want = distance.full(x, cut_off=cut_off)
        assert found.share == 1.0 and pairs_of(found.edges) == pairs_of(want if k is None else distance.nearest(want, k))
    assert voronoi.near(x, cut_off=0.1).share < 1


def test_k_best_of_each_group_go_on(spark, wide):
    """of each query and group of blocks k pairs leave a task, not k of each block."""
    over = blocked.Blocks.of(cloud(spark, wide), 4)
    made = blocked.neighbours(over, over, "euclidean", None, 5)
    assert over.groups < over.blocks and made.count() <= over.n * over.groups * 5
    assert pairs_of(distance.nearest(made, 5)) == pairs_of(distance.nearest(distance.full(cloud(spark, wide)), 5))
