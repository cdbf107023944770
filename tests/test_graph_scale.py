"""Graph walks send no tables to the driver to be broadcast, round by round."""

from __future__ import annotations

from quarry.operators import graph


def test_walks_broadcast_nothing(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = graph.cut(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))
    nodes = graph.cut(spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "node string, colour string"))
    assert {(r.node, r.colour) for r in graph._spread(edges, nodes, 9).collect()} == {(n, "a") for n in "abc"}
    pairs = spark.createDataFrame([("a", "c"), ("c", "a")], "start string, goal string")
    assert {(r.start, r.reaches) for r in graph.reachable(edges, graph.reach_labels(edges), pairs).collect()} == {("a", True), ("c", False)}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
