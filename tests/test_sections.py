"""Names in titles and bodies of sections, without a row for each pair of name and section."""

import itertools

from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.functions import text as X
from loomgraph.functions import udfs as U
from loomgraph.operators import docs
from tests.test_graph import make_nodes, pairs

NAMES = ["c++", "the,", "GRU", "a b", "İan", "深度 网络", "   ", "　　　", "x.y", "\\E\\Q", "ab", "naïve", "aa aa", "K-means", "section 12", None]
BODIES = ["we use C++ and c++x, the, end", "congruent gru", "gru", "Ägru", "gruß gru_", "the深度网络 a b", "a  b", "İAN i̇an", "深度\n网络", "x.y", "xxy", "\\e\\q", "NAÏVE", "aa aa aa", "é aa aa", "1k-means", "k-means—", "gru𝒜", "𝄞gru𝄞", "", "   x", "深gru, gru"]


def sections(spark, rows):
    full = spark.createDataFrame(rows, "book string, ord int, title string, body string")
    return full


def named(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "node_id long, name string")


def test_names_in_bodies_as_in_the_sql(spark):
    names, rows = named(spark), sections(spark, [(f"b{i % 3}", i, "t", b) for i, b in enumerate(BODIES)] + [("b0", None, "t", "gru c++")])
    want = names.crossJoin(rows).where(X.name_in_text(F.col("name"), F.col("body"))).select("node_id", "book", "ord").distinct()
    got = docs.body_hits(names, rows)
    assert pairs(got, "node_id", "book", "ord") == pairs(want, "node_id", "book", "ord")
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
    # A letter of two UTF-16 units before a name is a letter in the SQL, too; Java's look-behind takes its half for none.
    assert (2, "b", 1) not in pairs(docs.body_hits(names, sections(spark, [("b", 1, "t", "𝒜gru")])), "node_id", "book", "ord")


def test_names_in_titles(spark):
    titles = ["1.2 K-Means", "k means!", "kmeans clustering", "Section 12", "12 section 12", "section 1", "", "深度网络", "深度Q网络", None, "GRUs", "naive"]
    names, rows = named(spark), sections(spark, [("b", i, t, "x") for i, t in enumerate(titles)])
    got = docs.title_hits(names, rows)
    want = set()
    for (node, name), (i, core) in itertools.product(enumerate(NAMES), [(r["ord"], r["core"]) for r in rows.select("ord", X.title_core(F.col("title")).alias("core")).collect()]):
        if name is not None and core is not None:
            a, b = len(name.replace(" ", "")), len(core.replace(" ", ""))
            if min(a, b) >= 0.59 * max(a, b) and U.similarity(name, core) >= 0.75:
                want.add((node, "b", i))
    assert want and pairs(got, "node_id", "book", "ord") == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan


def test_shards_of_names_give_the_same(spark, monkeypatch):
    names, rows = named(spark), sections(spark, [("b", i, "section 12", b) for i, b in enumerate(BODIES)])
    want = [sorted(map(tuple, f(names, rows).collect())) for f in (docs.body_hits, docs.title_hits)]
    monkeypatch.setattr(docs, "NAME_CHARS", 20)
    assert want == [sorted(map(tuple, f(names, rows).collect())) for f in (docs.body_hits, docs.title_hits)]


def test_first_places(spark):
    """A title beats mentions; a place without a number comes first."""
    nodes = make_nodes(spark, [(1, "gru", ["grus"], [], "seed"), (2, "gone", [], [], "rejected")])
    rows = [("a", 1, "x", "gru"), ("a", 3, "GRU", "gone"), ("a", 2, "grus", "y"), ("b", 5, "x", "gru gone"), ("b", None, "x", "gru"), ("c", 4, "GRU", "")]
    full = spark.createDataFrame([(i, b, o, str(i), t, "", "en", x, x, "", None, None) for i, (b, o, t, x) in enumerate(rows)], S.DOC_SECTIONS)
    assert pairs(docs.concept_positions(nodes, full), "node_id", "book", "ord", "how") == {(1, "a", 2, "title"), (1, "b", None, "body")}
