import random

import pytest
from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.operators import export, graph, guards


def make_edges(spark, rows):
    full = [(i + 1, a, b, t, 0.5, "", "doc:b:1@0123abcd", s, 0.0) for i, (a, b, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, S.EDGES)


def make_nodes(spark, rows):
    full = [(i, n, "concept", al, "", fa, st, "seed:x", None, float(i)) for i, n, al, fa, st in rows]
    return spark.createDataFrame(full, S.NODES)


def pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def reach(links):
    out = set(links)
    while True:
        more = {(a, d) for a, b in out for c, d in links if b == c} - out
        if not more:
            return out
        out |= more


@pytest.mark.parametrize("seed", range(3))
def test_closure_cycles_redundancy(spark, seed):
    rng = random.Random(seed)
    links = {(rng.randint(1, 9), rng.randint(1, 9)) for _ in range(13)}
    df = spark.createDataFrame(sorted(links), "src long, dst long")
    assert pairs(graph.closure(df), "src", "dst") == reach(links)
    edges = make_edges(spark, [(a, b, "is_a", "approved") for a, b in sorted(links)])
    assert pairs(graph.cycle_edges(edges, "is_a"), "src", "dst") == {(a, b) for a, b in links if (b, a) in reach(links) or a == b}
    plain = {(a, b) for a, b in links if a != b}
    want = set()
    for a, c in plain:
        seen, todo = {a, c}, [x for s, x in plain if s == a and x != c]
        while todo:
            u = todo.pop()
            if (u, c) in plain:
                want.add((a, c))
                break
            if u not in seen:
                seen.add(u)
                todo += [x for s, x in plain if s == u and x not in seen]
    assert pairs(graph.redundant(df), "src", "dst") == want


def test_degree_counts_a_loop_once(spark):
    e = make_edges(spark, [(1, 1, "is_a", "seed"), (1, 2, "is_a", "approved"), (2, 3, "is_a", "rejected")])
    assert pairs(graph.degree(e), "node_id", "degree") == {(1, 2), (2, 1)}


def test_guards(spark):
    nodes = make_nodes(spark, [(1, "A", ["aa"], ["bb"], "seed"), (2, "B", ["BB"], [], "approved"), (3, "C", [], [], "seed"), (4, "D", [], ["a"], "rejected")])
    edges = make_edges(spark, [(1, 2, "is_a", "seed"), (2, 1, "is_a", "approved"), (1, 9, "part_of", "proposed")])
    assert pairs(guards.mutual_edges(edges), "src", "dst") == {(1, 2)}
    assert pairs(guards.orphans(nodes, edges), "name") == {("C",)}
    assert pairs(guards.bad_endpoints(nodes, edges), "src", "dst") == {(1, 9)}
    assert pairs(guards.facet_shadows(nodes), "name", "facet", "target") == {("A", "bb", "B")}
    found = guards.all_guards(nodes, edges)
    assert {r["guard"] for r in found.collect()} == {"cycle:is_a", "mutual", "endpoint", "orphan", "facet_shadow"}


def test_neighborhood(spark):
    nodes = make_nodes(spark, [(i, f"n{i}", [], ["f", "误区:wrong"], "seed") for i in range(1, 5)])
    edges = make_edges(spark, [(1, 2, "prerequisite_of", "seed"), (2, 3, "prerequisite_of", "seed"), (3, 4, "is_a", "seed"), (1, 3, "prerequisite_of", "proposed")])
    r = export.neighborhood(nodes, edges, nodes.where("id = 3").select("id")).first()
    assert (r["direct_prerequisites"], r["prerequisite_chain"], r["unlocks"], r["taxonomy"]) == (["n2"], ["n2", "n1"], None, ["n3 -is_a-> n4"])
    assert (r["facets"], r["misconceptions"]) == (["f"], ["wrong"])


def test_html_page(spark, tmp_path):
    nodes = make_nodes(spark, [(1, "</script>", [], [], "seed"), (2, "B", [], [], "rejected")])
    out = export.write_html(nodes, make_edges(spark, [(1, 2, "is_a", "seed")]), str(tmp_path / "g.html"))
    page = open(out, encoding="utf-8").read()
    assert '"links": []' in page and "<\\/script>" in page


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], S.NODES), spark.createDataFrame([], S.EDGES)
    assert guards.all_guards(nodes, edges).count() == 0
    assert graph.ancestors(edges).count() == 0 and graph.degree(edges).agg(F.count("*")).first()[0] == 0
