"""Connected parts are settled whole: rounds don't grow with held edges or with the length of a path."""

import random
import uuid

import pytest

from loomgraph import schema as S
from loomgraph.operators import graph, parts, verify
from tests.test_graph import make_edges, reach


def jobs(spark, make):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return make().collect(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


def greedy(base, todo):
    links, out = set(base), set()
    for i, a, b in sorted(todo):
        if a == b or (b, a) in reach(links):
            out.add(i)
        else:
            links.add((a, b))
    return out


def eligible(spark, rows):
    return spark.createDataFrame(rows, "id long, src long, dst long, type string, decision string")


def test_held_edges_take_no_round_each(spark):
    rows = [(4 * i + k, 10 * i + a, 10 * i + b, "is_a", "approve") for i in range(20) for k, (a, b) in enumerate([(1, 2), (2, 3), (3, 1), (2, 1)])]
    rows, n = jobs(spark, lambda: verify.without_cycles(eligible(spark, rows), spark.createDataFrame([], S.EDGES)))
    assert {r["id"] for r in rows if r["decision"] == "hold"} == {4 * i + k for i in range(20) for k in (2, 3)}
    assert n < 60


@pytest.mark.parametrize("most", [1 << 14, 0])
def test_holds_are_greedy(spark, monkeypatch, most):
    monkeypatch.setattr(parts, "SQUARE", most)
    monkeypatch.setattr(parts, "LINEAR", most)
    rng = random.Random(most)
    live = [(rng.randint(1, 8), rng.randint(1, 8), "is_a", "seed") for _ in range(5)]
    todo = [(100 + i, rng.randint(1, 8), rng.randint(1, 8)) for i in range(9)]
    asked = eligible(spark, [(*x, "is_a", "approve") for x in todo] + [(1, 1, 2, "part_of", "approve"), (2, 2, 1, "part_of", "reject"), (3, 2, 1, "related_to", "approve")])
    out = {r["id"]: r["decision"] for r in verify.without_cycles(asked, make_edges(spark, live)).collect()}
    held = greedy({x[:2] for x in live}, todo)
    assert held and out == {1: "approve", 2: "reject", 3: "approve"} | {i: "hold" if i in held else "approve" for i, _, _ in todo}


def chain(spark, n):
    return [(i, i + 1) for i in range(n)]


def test_long_paths_take_no_round_for_each_link(spark):
    links = [*chain(spark, 40), (38, 36)]
    edges = make_edges(spark, [(a, b, "is_a", "seed") for a, b in links] + [(a, b, "part_of", "seed") for a, b in links[:-1]])
    rows, n = jobs(spark, lambda: graph.cycle_edges(edges, *S.ACYCLIC_TYPES))
    assert {(r["type"], r["src"], r["dst"]) for r in rows} == {("is_a", 36, 37), ("is_a", 37, 38), ("is_a", 38, 36)} and n < 30


def test_redundant_links_of_a_long_path(spark):
    df = spark.createDataFrame([*chain(spark, 40), (0, 30)], "src long, dst long")
    rows, n = jobs(spark, lambda: graph.redundant(df))
    assert {(r["src"], r["dst"]) for r in rows} == {(0, 30)} and n < 30


def test_closure_of_a_long_path(spark):
    df = spark.createDataFrame(chain(spark, 40), "src long, dst long")
    rows, n = jobs(spark, lambda: graph.closure(df, df.where("src IN (0, 38)").select("src")))
    assert {(r["src"], r["dst"], r["depth"]) for r in rows} == {(0, i, i) for i in range(1, 41)} | {(38, 39, 1), (38, 40, 2)} and n < 30


def test_large_parts_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    links = sorted({(rng.randint(1, 20), rng.randint(1, 20)) for _ in range(22)})
    df = spark.createDataFrame(links, "src long, dst long")
    edges = make_edges(spark, [(a, b, t, "approved") for a, b in links for t in ("is_a", "part_of")])
    want = [sorted(map(tuple, f().collect())) for f in (lambda: graph.closure(df), lambda: graph.cycle_edges(edges, "is_a", "part_of"), lambda: graph.redundant(df))]
    monkeypatch.setattr(parts, "SQUARE", 3)
    monkeypatch.setattr(parts, "LINEAR", 3)
    assert want == [sorted(map(tuple, f().collect())) for f in (lambda: graph.closure(df), lambda: graph.cycle_edges(edges, "is_a", "part_of"), lambda: graph.redundant(df))]


@pytest.mark.parametrize("chunk", [1 << 19, 0])
def test_parts_over_partitions(spark, monkeypatch, chunk):
    """Neighbours that lie far apart in the table end in one part, whether one task or rounds join them."""
    monkeypatch.setattr(parts, "CHUNK", chunk)
    links = [(k, 1000 * j + i, 1000 * j + i + 1) for k in ("x", "y") for j in range(3) for i in range(30)]
    random.Random(1).shuffle(links)
    rows = parts.with_part(spark.createDataFrame(links, "type string, src long, dst long").repartition(7)).collect()
    found = {(r["type"], r["src"] // 1000, r["part"]) for r in rows}
    assert len(rows) == len(links) and len(found) == 6 and len({x[::2] for x in found}) == 6
