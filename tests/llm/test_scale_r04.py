"""Findings of round 4: joins of collocations that must not be broadcast."""

from tideline.llm import collocations


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_collocations_join_nodes_by_shuffles(spark):
    """compressed files of all nodes look small; as a broadcast they go through the driver."""
    nodes = spark.createDataFrame([("en", "a", "b", 2, 40), ("en", "a", "", 1, 50), ("en", "b", "", 1, 60)], "lang string, w1 string, w2 string, depth int, f long")
    scored = collocations.with_cuts(collocations.with_left_parts(nodes, 2), nodes, 2)
    assert "Broadcast" not in plan(scored)
    assert [(r["a"], r["l"], r["r"], r["score"]) for r in scored.collect()] == [(40, 50, 60, 2000000 * 40 // 110)]
    longer = spark.createDataFrame([("en", "a", "b", "c", 3, 40), ("en", "a", "b", "", 2, 45)], "lang string, w1 string, w2 string, w3 string, depth int, a long")
    left = collocations.uncovered(longer, 3, 80)
    assert "Broadcast" not in plan(left) and [r["w3"] for r in left.collect()] == ["c"]
