import json

import pytest
from pyspark.sql import functions as F

from loomgraph import schema as S
from loomgraph.plans import batch
from loomgraph.sources import config, files, replay
from loomgraph.sources.catalog import Catalog, get_node, list_edges, named
from loomgraph.streaming import reviews
from tests.test_graph import make_edges, make_nodes, pairs

BOOK = {"book": "b-1", "title": "T", "lang": "en", "type": "html", "sections": [[1, "1", "One", "path:a.txt"], [2, "2", "Two", "http://x"]]}


def test_book_rules(spark):
    assert config.book_sections(spark, config.check_book(BOOK)).count() == 2
    for change in ({"title": ""}, {"book": "B 1"}, {"type": "doc"}, {"tier": "top"}, {"type": "pdf"}, {"sections": [[1, "1", "x"]]}):
        with pytest.raises(ValueError):
            config.check_book(BOOK | change)
    assert config.book_tiers([BOOK, BOOK | {"book": "c", "tier": "low"}]) == {"b-1": "high", "c": "low"}
    assert files.page_range("pages:3-10") == (3, 10)
    with pytest.raises(ValueError):
        files.page_range("3-10")


def test_seed_graph(spark):
    data = {"source": "seed:x", "nodes": [{"name": "A", "aliases": ["a1"]}, {"name": " B "}, {"name": "a1"}], "edges": [["a1", "is_a", "B"], ["A", "is_a", "b", 0.5], ["B", "related_to", "A"], ["A", "related_to", "B"], ["A", "is_a", "nobody"]]}
    nodes, edges, skipped = config.seed_graph(spark, data)
    assert pairs(nodes, "id", "name") == {(1, "A"), (2, "B")}
    assert pairs(edges, "src", "dst", "type", "confidence") == {(1, 2, "is_a", 1.0), (2, 1, "related_to", 1.0)}
    assert skipped.count() == 1


def test_seed_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("source: 'seed:y'\nnodes:\n  - name: X\nedges: []\n", encoding="utf-8")
    assert config.load_seed(spark, str(tmp_path / "s.yaml"))[0].first()["source"] == "seed:y"


def test_catalog_and_daily_run(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/tables")
    assert c.read("nodes").count() == 0
    c.replace("nodes", make_nodes(spark, [(1, "alpha", [], [], "seed"), (2, "beta", [], [], "seed")]))
    c.replace("edges", make_edges(spark, [(1, 2, "is_a", "proposed")]))
    c.replace("corpus", spark.createDataFrame([(1, "en", 1, "alpha", 3, "t", ["al"], ["beta"], ["beta"], 0.0), (2, "en", 2, "beta", 3, "t", [], [], [], 0.0)], S.CORPUS))
    c.replace("review_signals", spark.createDataFrame([("edge", 1, None, "支持", "fine", 0.0)], S.REVIEW_SIGNALS))
    done = batch.daily(c, "b1")
    assert [s.error for s in done] == [None] * len(done)
    assert get_node(c.read("nodes"), 1).first()["aliases"] == ["al"] and named(c.read("nodes"), "AL").first()["id"] == 1
    assert pairs(list_edges(c.read("edges"), "approved"), "src", "dst", "type") == {(1, 2, "is_a")}
    assert pairs(c.read("edges").where("type = 'part_of'"), "src", "dst", "status") == {(1, 2, "proposed")}
    assert pairs(c.read("review_log"), "id", "item_type", "action", "batch_id") == {(1, "edge", "approve", "b1")}
    batch.undo(c, "b1", 1.0)
    assert c.read("edges").where("status = 'approved'").count() == 0 and c.read("review_log").count() == 2
    assert [s.error is None for s in batch.run_steps([("bad", lambda: 1 / 0), ("good", lambda: 1)])] == [False, True]


def test_shadow_run_changes_no_status(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/tables")
    c.replace("nodes", make_nodes(spark, [(1, "a", [], [], "seed"), (2, "b", [], [], "seed")]))
    c.replace("edges", make_edges(spark, [(1, 2, "is_a", "proposed")]))
    sig = tuple({"link_src_dst": True}.get(f.name) for f in S.SIGNALS)
    c.replace("review_signals", spark.createDataFrame([("edge", 1, sig, "支持", "", 0.0)], S.REVIEW_SIGNALS))
    batch.adjudicate(c, "b", 0.0, shadow=True)
    assert c.read("review_signals").first()["signals"]["auto_would"] == "approve" and c.read("edges").first()["status"] == "proposed"


class Busy:
    def __init__(self, fails):
        self.fails = fails

    def ask(self, question):
        if self.fails:
            self.fails -= 1
            raise replay.Retry(1.5)
        return f"answer {question}"


def test_retries():
    waits = []
    assert replay.patient(Busy(2), "q", wait=1.0, sleep=waits.append) == "answer q" and waits == [1.5, 2.0]
    with pytest.raises(replay.Retry):
        replay.patient(Busy(9), "q", sleep=lambda s: None)


def test_replayed_answers(spark):
    client = replay.Replay({"good": 'so: {"a": 1}', "bad": "no json", "repair JSON: bad": "x", "repair JSON: no json": "[2]"})
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "unknown")], "id long, question string")
    got = {r["id"]: (r["answer"], (r["error"] or "")[:8]) for r in replay.ask_all(rows, client, as_json=True, parallel=2).collect()}
    assert got == {1: ('{"a": 1}', ""), 2: ("[2]", ""), 3: (None, "KeyError")}
    vectors = replay.embed_all(rows.select("id", F.col("question").alias("text")), replay.HashVectors(8))
    assert {len(r["embedding"]) for r in vectors.collect()} == {8}
    links = spark.createDataFrame([("Q1", "en", "E", "e"), ("Q1", "zh", "Z", "z"), ("Q2", "fr", "F", "f")], "qid string, lang string, title string, label string")
    assert pairs(replay.first_sitelink(links), "qid", "title") == {("Q1", "Z")}


def test_recorded_pages(spark, tmp_path):
    page = {"lang": "en", "page_id": 1, "title": "T", "revision_id": 2, "text": "x" * 70_000, "links": ["a"]}
    (tmp_path / "p.jsonl").write_text(json.dumps(page) + "\n", encoding="utf-8")
    spark.dataSource.register(replay.RecordedPages)
    got = spark.read.format("recorded_pages").option("path", str(tmp_path)).load().first()
    assert (got["title"], len(got["text"]), got["links"], got["redirects"]) == ("T", 60_000, ["a"], [])


def test_text_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("  body\nline ", encoding="utf-8")
    rows = spark.createDataFrame([("b", "1", "path:a b.txt"), ("b", "2", "http://x")], "book string, sec_id string, url string")
    assert pairs(files.text_bodies(spark, rows, str(tmp_path)), "sec_id", "body") == {("1", "body\nline")}
    html = spark.createDataFrame([("b", "1", "<p>x</p>")], "book string, sec_id string, html string")
    assert files.html_bodies(html).first()["body"] == "x"


def test_review_stream(spark, tmp_path):
    rows = [(i, "edge", i % 3, "approve", "", "", "human", "", 1000.0 * i) for i in range(8)]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, S.REVIEW_LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen = []
    stream = reviews.first_decisions(reviews.log_stream(spark, str(tmp_path / "log"), 1))
    reviews.follow(stream, str(tmp_path / "ck"), lambda df, n: seen.extend((n, r["item_id"]) for r in df.collect())).awaitTermination()
    assert sorted(i for _, i in seen) == [0, 1, 2]
    hours = reviews.counts_by_hour(reviews.log_stream(spark, str(tmp_path / "log")))
    q = hours.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM hours").first()[0] == 8
