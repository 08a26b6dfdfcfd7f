from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions import udfs as U


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


def test_similarity_cases():
    assert round(U.similarity("深度Q网络", "深度神经网络"), 4) == 0.7273
    assert U.similarity("目标检测", "维奥拉-琼斯目标检测框架") < 0.75
    assert U.similarity("linear model", "Linear Models") == 1.0
    assert U.similarity("", "x") == U.similarity(None, None) == 0.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abAB c网络", max_size=12), st.text(alphabet="abAB c网络", max_size=12)), min_size=1, max_size=8))
def test_alike_is_similarity(pairs):
    import pandas as pd

    q, t = pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])
    assert U.alike(q, t).tolist() == [U.similarity(a, b) >= 0.75 for a, b in pairs]


def test_evidence(spark):
    cases = [("A b…d e", "d e and then a  B", True), ("a...z", "a b", False), ("", "text", False), ("…", "text", False), (None, "text", False), ("x", None, False), ("全　文", "这是全文", True)]
    rows = spark.createDataFrame([(i, e, t) for i, (e, t, _) in enumerate(cases)], "i int, e string, t string")
    got = {r["i"]: r["v"] for r in rows.select("i", X.evidence_in_text(F.col("e"), F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_names_in_text(spark):
    cases = [("GRU", "a gru cell", True), ("GRU", "congruent", False), ("ab", "ab", False), ("注意力", "自注 意力机制", True), ("C++\\E x", "use c++\\e x now", False), ("gru", "用gru模型", False)]
    rows = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(cases)], "i int, n string, t string")
    got = {r["i"]: r["v"] for r in rows.select("i", X.name_in_text(F.col("n"), F.col("t")).alias("v")).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 5)] == [cases[i][2] for i in (0, 1, 2, 3, 5)]


def test_sources(spark):
    p = one(spark, X.parse_section_source(F.col("s")), s="doc:cs-1:3.1@0123abcd")
    assert (p["book"], p["sec_id"], p["hash"]) == ("cs-1", "3.1", "0123abcd")
    assert one(spark, X.parse_section_source(F.col("s")), s="wiki:en:x@1") is None
    assert one(spark, X.title_core(F.col("s")), s="3.1． 线性回归 ") == "线性回归"
    assert one(spark, X.without_tags(F.col("s")), s="[推断] [x] because") == "because"
    assert one(spark, X.norm(F.col("s")), s=" A　B\tc ") == "abc"


def test_excerpt(spark):
    body = "x" * 600 + "needle in text" + "y" * 600
    got = one(spark, X.excerpt(F.col("t"), F.col("e")), t=body, e="[tag] needle in text")
    assert got == "x" * 500 + "needle in text" + "y" * 500
    assert one(spark, X.excerpt(F.col("t"), F.col("e")), t=body, e="absent") == body[:1000]


def test_chunk_order():
    assert U.chunks("short\n\n" + "x" * 25, 10) == ["x" * 10, "x" * 10, "short", "x" * 5]
    assert U.chunks("ab\n\ncd\n\n\nefghij", 8) == ["ab\n\ncd", "efghij"]
    assert U.chunks(None, 5) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(3, 20))
def test_chunks_fit(text, limit):
    got = U.chunks(text, limit)
    assert all(0 < len(c) <= limit for c in got)
    assert sorted("".join("".join(got).split())) == sorted("".join(text.split()))


def test_blocks():
    text = "lead\n== One ==\nbody one\n== References ==\nskip me\n=== Empty ===\n\n== Two ==\nbody two"
    assert U.blocks(text) == ["lead\nOne\nbody one\nTwo\nbody two"]
    assert U.blocks(text, 16) == ["lead", "One\nbody one", "Two\nbody two"]


def test_html():
    page = "<html><nav>menu</nav><main><h1>T¶</h1><p>a &amp; b</p><script>x()</script><pre>code</pre><p></p><p>c</p></main><p>out</p></html>"
    assert U.html_to_text(page) == "T\n\na & b\n\nc"
    assert U.html_to_text("<p>only</p>") == "only"
    assert U.html_to_text(None) == ""


def test_json_in():
    assert U.json_in('said ```json\n{"a": [1, "}"]}\n``` done') == '{"a": [1, "}"]}'
    assert U.json_in("[1, 2] and {3}") == "[1, 2]"
    assert U.json_in("nothing") is None and U.json_in(None) is None
