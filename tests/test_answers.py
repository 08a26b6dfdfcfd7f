"""Cases that wrong shortcuts get wrong."""

from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.functions import text as X
from loomgraph.operators import docs, ingest
from loomgraph.plans import edits  # noqa: F401  registers its queries
from loomgraph.plans import queries as Q
from loomgraph.sources.catalog import Catalog
from tests.oracle import compare


def test_quotations_are_found_whatever_their_words(spark):
    quotes = [(1, "the first passage…second passage ends here"), (2, "the quick brown fox jumps"), (3, "量子 计算"), (4, ""), (5, None), (6, "THE FIRST"), (7, "a...missing"), (8, "x")]
    texts = [(1, "here: The first passage; a Second  passage ends\nhere."), (2, "see the quickbrown fox jumps"), (3, "关于量子计算。"), (4, None), (5, ""), (6, "the first")]
    quotes, texts = spark.createDataFrame(quotes, "item_id long, quote string"), spark.createDataFrame(texts, "doc_id long, text string")
    want = quotes.crossJoin(texts).where(X.evidence_in_text(F.col("quote"), F.col("text"))).select("item_id", "doc_id")
    got = sorted(map(tuple, docs.quoted_in(quotes, texts).collect()))
    assert got == sorted(map(tuple, want.collect())) == [(1, 1), (2, 2), (3, 3), (6, 1), (6, 6), (8, 2)]


def test_quotations_in_shards(spark, monkeypatch):
    monkeypatch.setattr(docs, "PASSAGE_CHARS", 5)
    quotes = spark.createDataFrame([(i, f"word{i}") for i in range(6)], "item_id long, quote string")
    texts = spark.createDataFrame([(i, f"a word{i} here") for i in range(6)], "doc_id long, text string")
    assert sorted(map(tuple, docs.quoted_in(quotes, texts).collect())) == [(i, i) for i in range(6)]


def test_duplicates_of_null_texts(spark, tmp_path):
    spark.createDataFrame([(1, "A"), (2, None), (3, " a"), (4, None), (5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.exact_duplicates(spark, str(tmp_path)).select("doc_id", "copies", "first_id").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1), (2, 2, 2), (3, 2, 1), (4, 2, 2), (5, 1, 5)]


def test_equal_pages_have_blocks_of_their_own(spark):
    text = "\n".join(f"== H{i} ==\n" + "x " * 3500 for i in range(5))
    pages = spark.createDataFrame([(1, text), (1, text)], "id long, text string")
    out = ingest.picked_blocks(pages, F.array(F.lit("x"))).collect()
    assert len(out) == 6 and all(r["n_blocks"] == 3 for r in out)


def test_a_swap_that_was_cut_short(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    node = spark.createDataFrame([(1, "a")], "id long, name string")
    catalog.replace("nodes", node)
    for new in ("nodes.new", "nodes.old"):  # as if the run had ended between the renames
        (tmp_path / "nodes").rename(tmp_path / new)
        assert [r["name"] for r in catalog.read("nodes").collect()] == ["a"]
    (tmp_path / "nodes").rename(tmp_path / "nodes.old")
    S.conform(node.withColumn("name", F.lit("b")), S.TABLES["nodes"]).write.parquet(str(tmp_path / "nodes.new"))
    catalog.append("nodes", spark.createDataFrame([(2, "c")], "id long, name string"))
    assert sorted(r["name"] for r in catalog.read("nodes").collect()) == ["b", "c"]


def test_names_with_marks_at_their_ends(spark):
    cases = [("the,", "Reouha the, of", True), ("c++", "in c++ and c", True), ("c++", "c++x", False), (".net", "uses .NET", True), (".net", "asp.net", False), ("cafe", "a cafe\u0301", True), ("gru", "con_gru", False)]
    rows = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(cases)], "i long, n string, t string")
    got = {r["i"]: r["v"] for r in rows.select("i", X.name_in_text(F.col("n"), F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    sections = rows.select(F.lit("b").alias("book"), F.col("i").alias("ord"), F.col("t").alias("body"))
    hits = docs.body_hits(rows.select(F.col("i").alias("node_id"), F.col("n").alias("name")), sections).where("node_id = ord").collect()
    assert sorted(r["node_id"] for r in hits) == [i for i, c in enumerate(cases) if c[2]]


def test_overlap_with_neighbours_whose_names_end_in_a_mark(spark):
    compare(spark, "/root/testdata/sf0.01", Q.QUERIES["node_signals"], Q.SQL["node_signals"])
