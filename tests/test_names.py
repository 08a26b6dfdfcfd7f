from loomgraph.operators import names
from tests.test_graph import make_nodes


def test_name_index_needs_no_sort(spark):
    """Names are grouped by hash: a task sorts no rows to find the first node of each."""
    nodes = make_nodes(spark, [(2, "A", ["x"], [], "seed"), (1, "B", ["X", "a"], [], "seed"), (3, "x", [], [], "rejected")])
    index = names.name_index(nodes)
    assert {r["key"]: r["node_id"] for r in index.collect()} == {"a": 2, "b": 1, "x": 3}
    assert "SortAggregate" not in index._jdf.queryExecution().executedPlan().toString()
