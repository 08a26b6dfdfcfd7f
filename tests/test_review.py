from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.operators import calibrate, decisions, dedup, docs, ingest, mining, names, verify
from tests.test_graph import make_edges, make_nodes, pairs


def log(spark, rows):
    return spark.createDataFrame([(i, t, item, a, "", "doc:b:1@0123abcd", by, batch, float(at)) for i, t, item, a, by, batch, at in rows], S.REVIEW_LOG)


def signals(spark, rows):
    fields = [f.name for f in S.SIGNALS]
    return spark.createDataFrame([(t, i, tuple(sig.get(f) for f in fields), v, "", 0.0) for t, i, sig, v in rows], S.REVIEW_SIGNALS)


def test_first_decision_may_be_an_audit(spark):
    rows = log(spark, [(1, "edge", 1, "audit_confirm", "human", "", 1), (2, "edge", 1, "approve", "human", "", 2), (3, "edge", 2, "reject", "human", "", 1)])
    out = calibrate.human_precision(rows, spark.createDataFrame([], S.EDGES), signals(spark, [])).collect()
    assert [(r["approve"], r["reject"], r["precision"], r["bucket"]) for r in out] == [(0, 1, 0.0, "无信号")]


def test_rollback(spark):
    nodes = make_nodes(spark, [(1, "A", [], [], "approved"), (2, "B", [], [], "approved")])
    edges = make_edges(spark, [(1, 2, "is_a", "approved"), (2, 1, "is_a", "proposed")])
    rows = log(spark, [(1, "node", 1, "approve", "auto", "b1", 1), (2, "node", 2, "approve", "auto", "b1", 1), (3, "node", 2, "audit_confirm", "human", "", 2)])
    out = decisions.rollback(nodes, edges, rows, "b1")
    assert pairs(out, "item_type", "item_id", "outcome") == {("node", 1, "reverted"), ("node", 2, "skipped"), ("edge", 1, "cascaded")}
    back = out.where("outcome <> 'skipped'")
    assert pairs(decisions.with_status(nodes, back, "node", "proposed"), "id", "status") == {(1, "proposed"), (2, "approved")}
    assert {r["decided_by"] for r in calibrate.unaudited(rows).collect()} == {"auto"}


def test_auto_rules(spark):
    nodes = make_nodes(spark, [(i, f"n{i}", [], [], "seed") for i in range(1, 6)])
    edges = make_edges(spark, [(1, 2, "prerequisite_of", "seed"), (2, 3, "prerequisite_of", "proposed"), (3, 1, "prerequisite_of", "proposed"), (4, 5, "prerequisite_of", "proposed"), (5, 4, "related_to", "proposed"), (1, 5, "is_a", "proposed")])
    s = signals(spark, [
        ("edge", 2, {"toc": 1}, "支持"), ("edge", 3, {"link_src_dst": True}, "支持"), ("edge", 4, {"link_src_dst": True, "refd": -1}, "支持"),
        ("edge", 5, {"wikidata": "P737"}, "支持(方向存疑)"), ("edge", 6, {}, "不支持"),
    ])
    out = verify.apply_auto(nodes, edges, s)
    assert pairs(out, "item_type", "item_id", "decision") == {("edge", 2, "approve"), ("edge", 3, "hold"), ("edge", 6, "reject")}
    tiers = {r["item_id"]: r["tier"] for r in verify.triaged(nodes, edges, s).collect()}
    assert tiers == {2: 2, 3: 2, 4: 0, 5: 0, 6: 2}


def test_cycle_gate_is_sequential(spark):
    eligible = spark.createDataFrame([(1, 1, 2, "is_a", "approve"), (2, 2, 3, "is_a", "approve"), (3, 3, 1, "is_a", "approve"), (4, 3, 4, "is_a", "approve"), (5, 4, 2, "is_a", "approve"), (6, 4, 1, "is_a", "approve")], "id long, src long, dst long, type string, decision string")
    out = verify.without_cycles(eligible, spark.createDataFrame([], S.EDGES))
    assert pairs(out, "id", "decision") == {(1, "approve"), (2, "approve"), (3, "hold"), (4, "approve"), (5, "hold"), (6, "hold")}


def test_auto_nodes(spark):
    nodes = make_nodes(spark, [(1, "A", [], [], "proposed"), (2, "B", [], [], "proposed"), (3, "C", [], [], "proposed")])
    page = {"has_page": True, "exact_title": True}
    s = signals(spark, [("node", 1, page | {"neighbor_overlap": True}, "独立概念"), ("node", 2, page, "独立概念"), ("node", 3, {"has_page": False}, "独立概念")])
    assert pairs(verify.auto_nodes(nodes, s), "id", "decision") == {(1, "approve"), (2, "hold")}


def corpus(spark, rows):
    return spark.createDataFrame([(i, lang, i, title, 7, text, red, cat, links, 0.0) for i, lang, title, text, red, cat, links in rows], S.CORPUS)


def test_name_and_title_index(spark):
    nodes = make_nodes(spark, [(1, "Gone", ["x"], [], "rejected"), (2, "B", ["X", "gone"], [], "seed"), (3, "D", ["x"], [], "seed")])
    index = {r["key"]: r["node_id"] for r in names.name_index(nodes).collect()}
    assert index == {"gone": 1, "b": 2, "x": 2, "d": 3}
    pages = corpus(spark, [(1, "zh", "T", "", ["r"], [], []), (2, "en", "t", "", ["R", "q"], [], []), (3, "de", "z", "", [], [], [])])
    assert {r["key"]: r["page_id"] for r in names.title_index(pages).collect()} == {"t": 1, "r": 1, "q": 2}


def test_structural_signals(spark):
    nodes = make_nodes(spark, [(1, "alpha", [], [], "seed"), (2, "beta", ["bb"], [], "seed"), (3, "gamma", [], [], "proposed")])
    edges = make_edges(spark, [(1, 2, "prerequisite_of", "proposed"), (3, 1, "is_a", "proposed"), (1, 2, "is_a", "proposed")])
    pages = corpus(spark, [(1, "en", "alpha", "about beta", [], [], ["Zeta"]), (2, "en", "beta", "", [], [], ["Alpha"]), (3, "en", "gamma", "alpha inside", ["Gam"], [], [])])
    mapped = names.page_for_node(nodes, names.title_index(pages))
    spots = spark.createDataFrame([(1, "b", 1), (2, "b", 5), (1, "c", 2), (2, "c", 1)], "node_id long, book string, ord int")
    qids = spark.createDataFrame([(1, "Q1"), (2, "Q2")], "node_id long, qid string")
    claims = spark.createDataFrame([("Q1", {"P279": ["Q2"], "P737": ["Q2"]}, 0.0), ("Q2", {"P279": ["Q1"]}, 0.0)], S.CLAIMS)
    got = {r["item_id"]: r["signals"] for r in verify.edge_signals(nodes, edges, pages, mapped, spots, qids, claims).collect()}
    assert (got[1]["link_src_dst"], got[1]["link_dst_src"], got[1]["refd"], got[1]["toc"], got[1]["wikidata"]) == (False, True, 1, 0, "P279 src→dst，P279 dst→src，P737 src→dst")
    assert got[3]["refd"] is None and got[3]["toc"] is None
    node = verify.node_signals(nodes, edges, pages, mapped).first()["signals"]
    assert (node["has_page"], node["exact_title"], node["neighbor_overlap"]) == (True, True, True)


def test_claim_edges_and_shared_items(spark):
    nodes = make_nodes(spark, [(i, f"n{i}", [], [], "seed") for i in range(1, 5)])
    qids = spark.createDataFrame([(1, "Q1"), (2, "Q2"), (3, "Q3"), (4, "Q3")], "node_id long, qid string")
    claims = spark.createDataFrame([("Q1", {"P737": ["Q2"], "P279": ["Q3", "Q9"]}, 0.0), ("Q3", {"P279": ["Q1"]}, 0.0)], S.CLAIMS)
    out = mining.claim_edges(nodes, qids, claims)
    assert pairs(out, "src", "dst", "type") == {(2, 1, "related_to")}
    assert "[演化启发] [Wikidata] n1 受 n2 影响（P737）" in {r["rationale"] for r in out.collect()}
    assert [r["nodes"] for r in mining.shared_qids(qids).collect()] == [[3, 4]]
    assert pairs(mining.spine_targets(nodes, qids, claims), "qid", "child_id") == {("Q3", 1), ("Q9", 1)}


def test_aliases_go_to_the_first_node(spark):
    nodes = make_nodes(spark, [(1, "a", [], [], "seed"), (2, "b", ["kept"], [], "seed"), (3, "c", [], [], "seed")])
    pages = corpus(spark, [(1, "en", "a", "", ["New", "b", "new", "x" * 26], [], []), (3, "en", "c", "", ["NEW", "KEPT", "own"], [], [])])
    claims = mining.alias_claims(nodes, pages, names.page_for_node(nodes, names.title_index(pages)))
    assert pairs(claims, "node_id", "alias", "owner") == {(1, "New", None), (1, "b", "b"), (2, "New", "a"), (3, "NEW", "a"), (3, "KEPT", "b"), (3, "own", None)}
    assert pairs(mining.with_aliases(nodes, claims).select("id", F.concat_ws(",", "aliases").alias("a")), "id", "a") == {(1, "New"), (2, "kept"), (3, "own")}


def test_new_edges_are_symmetric_for_related(spark):
    edges = make_edges(spark, [(1, 2, "related_to", "seed"), (3, 4, "related_to", "rejected"), (5, 6, "is_a", "seed")])
    new = spark.createDataFrame([(2, 1, "related_to"), (4, 3, "related_to"), (6, 5, "is_a"), (5, 6, "is_a"), (7, 8, "related_to"), (8, 7, "related_to")], "src long, dst long, type string")
    assert pairs(mining.new_edges(new, edges), "src", "dst") == {(4, 3), (6, 5), (7, 8)}


def test_cascade(spark):
    nodes = make_nodes(spark, [(1, "alpha", ["al"], [], "seed"), (2, "beta", [], [], "seed")]).withColumn("embedding", F.when(F.col("id") == 2, F.array(F.lit(1.0), F.lit(0.0))).cast("array<float>"))
    pages = corpus(spark, [(1, "en", "alpha", "", ["redirected"], [], [])])
    asked = spark.createDataFrame([(1, "AL", None), (2, "Redirected", None), (3, "near", [0.99, 0.05]), (4, "far", [0.0, 1.0])], "query_id long, name string, embedding array<float>")
    judged = spark.createDataFrame([(3, 2, "facet")], "query_id long, node_id long, relation string")
    out = dedup.cascade(asked, nodes, pages, names.title_index(pages), judged)
    assert pairs(out, "query_id", "node_id", "how") == {(1, 1, "exact"), (2, 1, "redirect"), (3, 2, "facet:embedding(1.00)+llm"), (4, None, None)}
    merged = {r["id"]: r for r in dedup.merge_aliases(nodes, out).collect()}
    assert merged[1]["aliases"] == ["al", "AL", "Redirected"] and merged[2]["facets"] == ["near"]


def test_sections(spark):
    stored = spark.createDataFrame([(1, "b", 1, "1", "old", "u", "en", "o" * 200, "译", "h", 1.0, 2.0)], S.DOC_SECTIONS)
    new = spark.createDataFrame([("b", 5, "1", "new", "v", "en"), ("b", 6, "2", "t2", "w", "zh")], "book string, ord int, sec_id string, title string, url string, orig_lang string")
    out = docs.register(stored, new)
    assert pairs(out, "sec_id", "ord", "title", "text") == {("1", 5, "new", "译"), ("2", 6, "t2", "")}
    assert pairs(docs.registered(stored, new), "book", "sections", "added") == {("b", 2, 1)}
    bodies = spark.createDataFrame([("b", "1", "n" * 300), ("b", "2", "中" * 250), ("b", "3", "x")], "book string, sec_id string, body string")
    got = {r["sec_id"]: r for r in docs.store_bodies(out, bodies, 9.0).collect()}
    assert got["1"]["text"] == "" and got["1"]["translated_at"] is None and got["2"]["text"] == "中" * 250 and len(got["2"]["content_hash"]) == 12
    parts = spark.createDataFrame([("b", "1", 1, 2, " two "), ("b", "1", 0, 2, "one")], "book string, sec_id string, pos int, n int, translated string")
    assert {r["text"] for r in docs.store_translations(out, parts, 1.0).where("sec_id = '1'").collect()} == {"one\n\ntwo"}


def test_human_decisions(spark):
    nodes = make_nodes(spark, [(1, "a", [], [], "seed"), (2, "b", [], [], "proposed"), (3, "c", [], [], "proposed"), (4, "d", [], [], "proposed")])
    edges = make_edges(spark, [(2, 1, "is_a", "proposed"), (3, 1, "is_a", "proposed"), (4, 1, "part_of", "proposed"), (1, 4, "part_of", "seed")])
    asked = spark.createDataFrame([(2, "merge", "A"), (3, "demote", "a"), (4, "merge", "nobody")], "id long, action string, target string")
    n, e = decisions.decide_nodes(nodes, edges, asked)
    assert pairs(n.select("id", "status", F.concat_ws(",", "aliases").alias("al"), F.concat_ws(",", "facets").alias("f")), "id", "status", "al", "f") == {(1, "seed", "b", "c"), (2, "rejected", "", ""), (3, "rejected", "", ""), (4, "proposed", "", "")}
    assert pairs(e, "id", "src", "status") == {(1, 1, "proposed"), (2, 3, "rejected"), (3, 4, "proposed"), (4, 1, "seed")}
    turn = spark.createDataFrame([(1, "flip", None, None), (2, "retype", "related_to", "教学对比"), (3, "flip", None, None), (4, "retype", "nonsense", None)], "id long, action string, new_type string, kind string")
    out, told = decisions.decide_edges(edges, turn)
    assert pairs(out, "id", "src", "dst", "type", "status") == {(1, 1, 2, "is_a", "approved"), (2, 3, 1, "related_to", "approved"), (3, 4, 1, "part_of", "rejected"), (4, 1, 4, "part_of", "seed")}
    assert pairs(told, "id", "outcome") == {(1, "flip"), (2, "retype"), (3, "reject")}


def test_extraction(spark):
    nodes = make_nodes(spark, [(1, "known", [], [], "seed"), (2, "gone", [], [], "rejected")])
    answer = """{"concepts": [{"name": " New ", "definition": "d", "evidence": "first part", "edges": [
        {"other": "known", "type": "prerequisite_of", "inferred": "true", "direction": "other_to_new", "confidence": 0.9, "evidence": "first"},
        {"other": "known", "type": "related_to", "kind": "x", "evidence": "first"}, {"other": "none", "type": "is_a", "evidence": "first"},
        {"other": "known", "type": "is_a", "evidence": "absent words"}]}, {"name": "new", "evidence": "x"}, {"name": "Third", "evidence": "x"}],
        "anchor_facets": ["short", "this facet is much too long"], "misconceptions": [{"concept": "known", "text": "wrong idea", "evidence": "second part"}, {"concept": "gone", "text": "w", "evidence": "first"}]}"""
    a = ingest.parsed(spark.createDataFrame([("s", 0, answer)], "source string, pos int, answer string"))
    texts = spark.createDataFrame([("s", "First part … second part")], "source string, text string")
    found = ingest.evidenced(ingest.concepts(a, 2), texts)
    assert pairs(found, "name", "grounded") == {("New", True), ("Third", False)}
    edges = ingest.edge_candidates(found.where("grounded").withColumn("node_id", F.lit(9).cast("long")), texts, nodes)
    assert pairs(edges.where("dropped IS NULL"), "src", "dst", "confidence", "rationale") == {(1, 9, 0.6, "[推断] first")}
    assert sorted(r["dropped"] for r in edges.where("dropped IS NOT NULL").collect()) == ["endpoint", "evidence", "kind"]
    assert pairs(ingest.ingest_counts(found, edges), "what", "n") == {("concept kept", 1), ("concept without evidence", 1), ("edge kept", 1), ("edge without endpoint", 1), ("edge without evidence", 1), ("edge without kind", 1)}
    anchors = spark.createDataFrame([("s", 1)], "source string, node_id long")
    assert ingest.with_anchor_facets(nodes, a, anchors).where("id = 1").first()["facets"] == ["short"]
    assert ingest.with_misconceptions(nodes, a, texts).orderBy("id").first()["facets"] == ["误区:wrong idea"]
    new = ingest.add_nodes(nodes, spark.createDataFrame([("New", "d", ["n"], [], "s"), ("known", "", [], [], "s")], "name string, definition string, aliases array<string>, facets array<string>, source string"), 1.0)
    assert pairs(new, "id", "name", "status") == {(1, "known", "seed"), (2, "gone", "rejected"), (3, "New", "proposed")}


def test_picked_blocks(spark):
    text = "\n\n".join(f"part {i} " + ("key " * (i % 3)) + "z" * 5000 for i in range(6))
    rows = spark.createDataFrame([("p", text, ["key"])], "source string, text string, names array<string>")
    out = ingest.picked_blocks(rows, F.col("names"))
    assert [r["pos"] for r in out.orderBy("pos").collect()] == [0, 2, 5] and {r["n_blocks"] for r in out.collect()} == {3}


def test_source_excerpts(spark):
    pages = corpus(spark, [(1, "en", "Alpha", "x" * 30 + "the evidence" + "y" * 30, [], [], [])])
    sections = spark.createDataFrame([(1, "b", 1, "2", "t", "u", "zh", "o", "whole section", "0123abcd0000", 1.0, None)], S.DOC_SECTIONS)
    items = spark.createDataFrame([("wiki:en:alpha@7", "the evidence"), ("doc:b:2@0123abcd0000", "none"), ("doc:b:2@ffffffffffff", "section"), ("mine:category:en", "x")], "source string, evidence string")
    got = {r["source"]: (r["excerpt"], r["drifted"]) for r in verify.source_excerpts(items, pages, sections, 5).collect()}
    assert got == {"wiki:en:alpha@7": ("xxxxxthe evidenceyyyyy", False), "doc:b:2@0123abcd0000": ("whole sect", False), "doc:b:2@ffffffffffff": ("hole section", True), "mine:category:en": (None, False)}
    nodes = make_nodes(spark, [(1, "alpha", [], [], "seed"), (2, "none", [], [], "seed")])
    assert pairs(verify.page_heads(nodes, pages, names.page_for_node(nodes, names.title_index(pages)), 3), "node_id", "head") == {(1, "xxx"), (2, "（无语料页）")}
