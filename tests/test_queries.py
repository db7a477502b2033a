"""The registered queries: names, oracles, and a few of them side by side with DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["tsc_time_overview", "win_takens", "win_fd_center", "win_const_delta_sessions", "win_train_test_ids", "win_sliding_windows", "dist_range", "dist_knn", "kern_stochastic", "metric_rrmse_timestep", "cv_window", "dmd_2d", "dmdc_1d", "join_augment_control"])
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = db.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(str, normal(want))) == sorted(map(str, normal(got)))


def normal(frame):
    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple(None if str(v) in ("nan", "<NA>", "None", "NaT") else round(float(v), 4) + 0.0 if not isinstance(v, (str, bool)) else v for v in row))
    return out


def test_grid_search_runs_over_all_events(spark, monkeypatch):
    seen = []
    search = entry.own.edmd.grid_search
    monkeypatch.setattr(entry.own.edmd, "grid_search", lambda build, grid, tsc, *rest: seen.append(tsc.df.count()) or search(build, grid, tsc, *rest))
    assert sum(r["best"] for r in entry.queries()["edmd_cv"](spark, SF).collect()) == 1
    assert seen == [spark.read.parquet(f"{SF}/events.parquet").count()]
