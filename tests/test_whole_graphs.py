"""Graphs that bounds of loops once cut."""

import inspect

import pytest

from loomfacts.operators import fixpoint as G


def test_loops_have_no_bound_but_one_asked_for(spark, monkeypatch):
    monkeypatch.setattr(G, "JOINED_ROUNDS", 2)
    for f, bound in ((G.frontier, "most_rounds"), (G.reachable, "most_depth"), (G.invalidate, "most_rounds"), (G.strong_components, "most_rounds")):
        assert inspect.signature(f).parameters[bound].default is None
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert sorted((r["node"], r["depth"]) for r in G.reachable(edges, start).collect()) == [(i, i) for i in range(1, 7)]
    with pytest.raises(RuntimeError):
        G.invalidate(start, edges.selectExpr("dst as node", "src as input"), start.selectExpr("node", "'drop' as action"), most_rounds=2)
