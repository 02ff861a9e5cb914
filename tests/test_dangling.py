"""Edges without a known target, counted by relation."""

from conftest import rows

from trailgraph.operators import build as B


def test_count_dangling(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("a", "gone", "calls"), ("b", "gone", "calls"), ("b", None, "uses"), ("b", "a", None)], "src string, dst string, relation string")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    assert rows(B.count_dangling(edges, nodes), "relation", "kept", "dangling") == [("calls", 4, 2), ("uses", 1, 0), (None, 1, 0)]
