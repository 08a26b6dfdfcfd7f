"""Queries over the driver's tables, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import rules as R
from ..functions import text as X
from ..functions import udfs as U
from ..operators import calibrate, corpus, decisions, dedup, docs, export, graph, guards, ingest, mining, titles, verify
from ..operators import names as N
from ..operators.work import small_batches
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *parts: str):
    """Registers a function (spark, sf_dir); ``parts`` are the views that its SQL uses."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if 'UNION\n' in sql or 'RECUR' in sql else ''}" + ",\n".join(parts) + "\n" if parts else "") + sql.replace("RECUR", "")
        return f

    return put


def text_list(c: Column) -> Column:
    return F.coalesce(F.array_join(c, "|"), F.lit(""))


# --- graph scans, guards and traversal -------------------------------------------------------


@query("SELECT id, src, dst, type, status FROM live", V.SQL_EDGES)
def live_edges(spark, sf):
    return graph.live(V.edges(spark, sf)).select("id", "src", "dst", "type", "status")


@query("SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id, id FROM live UNION SELECT dst, id FROM live) GROUP BY 1", V.SQL_EDGES)
def degree(spark, sf):
    return graph.degree(V.edges(spark, sf))


@query("SELECT id, name FROM n WHERE status IN ('seed', 'approved') AND id NOT IN (SELECT src FROM live UNION SELECT dst FROM live)", V.SQL_NODES, V.SQL_EDGES)
def orphans(spark, sf):
    return guards.orphans(V.nodes(spark, sf), V.edges(spark, sf))


@query("SELECT a.type, a.src, a.dst FROM live a JOIN live b ON a.src = b.dst AND a.dst = b.src AND a.type = b.type AND a.id < b.id", V.SQL_EDGES)
def mutual_edges(spark, sf):
    return guards.mutual_edges(V.edges(spark, sf))


@query(
    """SELECT e.id, e.type, e.src, a.type AS src_type, e.dst, b.type AS dst_type FROM e LEFT JOIN n a ON a.id = e.src LEFT JOIN n b ON b.id = e.dst
WHERE e.status <> 'rejected' AND (coalesce(a.type, '') <> 'concept' OR coalesce(b.type, '') <> 'concept')""",
    V.SQL_NODES, V.SQL_EDGES,
)
def bad_endpoints(spark, sf):
    return guards.bad_endpoints(V.nodes(spark, sf), V.edges(spark, sf))


@query("SELECT n.id, n.name, n.facet, b.name AS target FROM n JOIN n b ON lower(b.name) = lower(n.facet) WHERE n.status <> 'rejected' AND b.status <> 'rejected' AND b.name <> n.name", V.SQL_NODES)
def facet_shadows(spark, sf):
    return guards.facet_shadows(V.nodes(spark, sf))


@query(
    """RECUR, r AS (
  SELECT dst AS node_id, src AS ancestor_id FROM live WHERE type = 'prerequisite_of'
  UNION
  SELECT r.node_id, l.src FROM r JOIN live l ON l.dst = r.ancestor_id AND l.type = 'prerequisite_of')
SELECT node_id, ancestor_id FROM r WHERE node_id <> ancestor_id""",
    V.SQL_EDGES,
)
def prerequisite_ancestors(spark, sf):
    return graph.ancestors(V.edges(spark, sf)).select("node_id", "ancestor_id")


@query(
    """RECUR, r AS (
  SELECT type, src, dst FROM live WHERE type <> 'related_to'
  UNION
  SELECT r.type, r.src, l.dst FROM r JOIN live l ON l.src = r.dst AND l.type = r.type)
SELECT DISTINCT l.type, l.src, l.dst FROM live l JOIN r ON r.type = l.type AND r.src = l.dst AND r.dst = l.src""",
    V.SQL_EDGES,
)
def cycle_edges(spark, sf):
    return graph.cycle_edges(V.edges(spark, sf), *S.ACYCLIC_TYPES)


@query(
    """RECUR, q AS (
  SELECT DISTINCT src, dst FROM live WHERE type = 'prerequisite_of' AND src <> dst),
r AS (
  SELECT a.src, a.dst, b.dst AS here FROM q a JOIN q b ON b.src = a.src AND b.dst <> a.dst
  UNION
  SELECT r.src, r.dst, q.dst FROM r JOIN q ON q.src = r.here WHERE r.here <> r.dst AND q.dst <> r.src)
SELECT DISTINCT src, dst FROM r WHERE here = dst""",
    V.SQL_EDGES,
)
def redundant_prerequisites(spark, sf):
    return graph.redundant(graph.live(V.edges(spark, sf), "prerequisite_of"))


@query(
    """SELECT DISTINCT node_id, line FROM (
  SELECT unnest([src, dst]) AS node_id, a.name || ' -' || live.type || '-> ' || b.name AS line FROM live JOIN n a ON a.id = src JOIN n b ON b.id = dst)""",
    V.SQL_NODES, V.SQL_EDGES,
)
def one_hop(spark, sf):
    return export.one_hop(V.nodes(spark, sf), V.edges(spark, sf))


@query(
    """, d AS (
  SELECT l.dst AS id, string_agg(s.name, '|' ORDER BY l.id) AS names FROM live l JOIN n s ON s.id = l.src WHERE l.type = 'prerequisite_of' GROUP BY 1),
u AS (
  SELECT l.src AS id, string_agg(s.name, '|' ORDER BY l.id) AS names FROM live l JOIN n s ON s.id = l.dst WHERE l.type = 'prerequisite_of' GROUP BY 1),
x AS (
  SELECT node AS id, string_agg(line, '|' ORDER BY eid) AS names FROM (
    SELECT l.id AS eid, a.name || ' -' || l.type || '-> ' || b.name AS line, unnest([l.src, l.dst]) AS node FROM live l JOIN n a ON a.id = l.src JOIN n b ON b.id = l.dst WHERE l.type IN ('is_a', 'part_of')) GROUP BY 1)
SELECT n.id, n.name, n.definition, n.facet AS facets, n.id::VARCHAR AS misconceptions, coalesce(d.names, '') AS direct_prerequisites, coalesce(u.names, '') AS unlocks, coalesce(x.names, '') AS taxonomy
FROM n LEFT JOIN d USING (id) LEFT JOIN u USING (id) LEFT JOIN x USING (id)""",
    V.SQL_NODES, V.SQL_EDGES,
)
def neighborhoods(spark, sf):
    n = V.nodes(spark, sf)
    out = export.neighborhood(n, V.edges(spark, sf), n.select("id"))
    return out.select("id", "name", "definition", *[text_list(F.col(c)).alias(c) for c in ("facets", "misconceptions", "direct_prerequisites", "unlocks", "taxonomy")])


@query(
    "SELECT l.src, l.dst, l.type, l.status FROM e l WHERE l.status <> 'rejected' AND src IN (SELECT id FROM n WHERE status <> 'rejected') AND dst IN (SELECT id FROM n WHERE status <> 'rejected')",
    V.SQL_NODES, V.SQL_EDGES,
)
def shown_links(spark, sf):
    return export.shown_graph(V.nodes(spark, sf), V.edges(spark, sf))[1]


@query(
    """SELECT id, name, coalesce(degree, 0) AS degree, created_at FROM n
LEFT JOIN (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id, id FROM live UNION SELECT dst, id FROM live) GROUP BY 1) d ON d.node_id = n.id
WHERE status IN ('seed', 'approved') ORDER BY degree, created_at DESC, id LIMIT 20""",
    V.SQL_NODES, V.SQL_EDGES,
)
def frontier_topk(spark, sf):
    return corpus.frontier(V.nodes(spark, sf), V.edges(spark, sf), 20)


@query(
    """, b AS (
  SELECT dst AS src, src AS dst, type FROM e),
d AS (
  SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = b.src AND e.dst = b.dst AND e.type = b.type)
    AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = b.dst AND e.dst = b.src AND e.type = b.type AND e.type = 'related_to' AND e.status <> 'rejected')),
r AS (
  SELECT *, row_number() OVER (PARTITION BY type, CASE WHEN type = 'related_to' THEN least(src, dst) ELSE src END, CASE WHEN type = 'related_to' THEN greatest(src, dst) ELSE dst END ORDER BY src) AS nth FROM (SELECT DISTINCT * FROM d))
SELECT src, dst, type FROM r WHERE nth = 1""",
    V.SQL_EDGES,
)
def new_edges(spark, sf):
    e = V.edges(spark, sf)
    turned = mining.candidate(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence", "rationale", "source"))
    return mining.new_edges(turned, e).select("src", "dst", "type")


# --- page corpus -----------------------------------------------------------------------------


@query("SELECT lang, title, n FROM c", V.SQL_PAGES)
def link_counts(spark, sf):
    return corpus.link_counts(V.pages(spark, sf))


@query("SELECT lang, title, n FROM c WHERE title NOT IN (SELECT key FROM t) ORDER BY n DESC, lang, title LIMIT 25", V.SQL_PAGES)
def grow_candidates(spark, sf):
    return corpus.grow_candidates(V.pages(spark, sf), 25, V.LANGUAGES)


@query("SELECT key, lang, title, page_id FROM t", V.SQL_PAGES)
def title_index(spark, sf):
    return N.title_index(V.pages(spark, sf), V.LANGUAGES)


@query("SELECT node_id, lang, page_id FROM m", V.SQL_PAGES)
def page_for_node(spark, sf):
    return N.page_for_node(V.page_nodes(spark, sf), N.title_index(V.pages(spark, sf), V.LANGUAGES))


@query("SELECT k.lang, k.page_id, min(w.id) AS node_id FROM k JOIN (SELECT id, name FROM w UNION ALL SELECT id, name || 's' FROM w) w ON w.name = k.key GROUP BY 1, 2", V.SQL_PAGES)
def node_for_page(spark, sf):
    return N.node_for_page(V.pages(spark, sf), V.page_nodes(spark, sf))


@query("SELECT page_id, length(text) AS n_chars FROM p WHERE length(text) >= 300", V.SQL_PAGES)
def usable_pages(spark, sf):
    return corpus.usable_pages(V.pages(spark, sf)).select("page_id", F.length("text").cast("long").alias("n_chars"))


@query("SELECT lang, count(*) AS pages, CAST(sum(len(links)) AS BIGINT) AS links, 2 * count(*) AS redirects FROM p GROUP BY 1", V.SQL_PAGES)
def corpus_stats(spark, sf):
    return corpus.corpus_stats(V.pages(spark, sf))


@query("SELECT (SELECT count(*) FROM m) AS covered, (SELECT count(*) FROM w) AS total", V.SQL_PAGES)
def coverage(spark, sf):
    return corpus.coverage(V.page_nodes(spark, sf), V.pages(spark, sf), V.LANGUAGES)


@query("SELECT w.id, w.name FROM w WHERE w.id NOT IN (SELECT node_id FROM m)", V.SQL_PAGES)
def crawl_queue(spark, sf):
    return corpus.crawl_queue(V.page_nodes(spark, sf), page_for_node(spark, sf)).select("id", "name")


@query(
    """SELECT m.node_id, w.name, sum(coalesce(c.n, 0))::DOUBLE AS score, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS indegree
FROM m JOIN w ON w.id = m.node_id JOIN k ON k.lang = m.lang AND k.page_id = m.page_id LEFT JOIN c ON c.lang = k.lang AND c.title = k.key GROUP BY 1, 2 ORDER BY score DESC, node_id LIMIT 30""",
    V.SQL_PAGES,
)
def anchor_topk(spark, sf):
    n, p = V.page_nodes(spark, sf), V.pages(spark, sf)
    none, log = spark.createDataFrame([], S.EDGES), spark.createDataFrame([], S.INGEST_LOG)
    return corpus.anchor_queue(n, none, p, log, 30, N.page_for_node(n, N.title_index(p, V.LANGUAGES)))


@query(
    """, a AS (
  SELECT m.node_id, 0 AS pos, trim(p.redirect) AS alias FROM m JOIN p USING (lang, page_id) UNION ALL SELECT m.node_id, 1, trim(p.redirect2) FROM m JOIN p USING (lang, page_id)),
f AS (
  SELECT *, first(node_id) OVER (PARTITION BY key ORDER BY node_id, pos) AS claimed, row_number() OVER (PARTITION BY node_id, key ORDER BY pos) AS nth
  FROM (SELECT *, lower(alias) AS key FROM a) a WHERE alias <> '' AND length(alias) <= 25 AND NOT EXISTS (SELECT 1 FROM w WHERE w.id = a.node_id AND a.key IN (w.name, w.name || 's')))
SELECT f.node_id, f.alias, CASE WHEN coalesce(x.id, y.id) <> f.node_id THEN coalesce(x.name, y.name) WHEN f.claimed <> f.node_id THEN z.name END AS owner
FROM f LEFT JOIN w x ON x.name = f.key LEFT JOIN w y ON y.name || 's' = f.key LEFT JOIN w z ON z.id = f.claimed WHERE nth = 1""",
    V.SQL_PAGES,
)
def alias_claims(spark, sf):
    n, p = V.page_nodes(spark, sf), V.pages(spark, sf)
    return mining.alias_claims(n, p, page_for_node(spark, sf)).select("node_id", "alias", "owner")


@query(
    """SELECT DISTINCT m.node_id AS src, x.id AS dst, 'part_of' AS type, 'mine:category:' || m.lang AS source
FROM m JOIN p USING (lang, page_id) JOIN (SELECT id, 'cat ' || name AS key FROM w) x ON x.key = lower('cat ' || p.redirect) WHERE x.id <> m.node_id""",
    V.SQL_PAGES,
)
def category_edges(spark, sf):
    n, p = V.page_nodes(spark, sf), V.pages(spark, sf)
    named = n.withColumn("aliases", F.array(F.concat(F.lit("cat "), "name")))
    return mining.category_edges(named, p, page_for_node(spark, sf)).select("src", "dst", "type", "source")


@query()
def html_text(spark, sf):
    small_batches(spark)
    return V.table(spark, sf, "pages").select("page_id", U.html_text("html").alias("text"))


# --- sections and evidence -------------------------------------------------------------------


@query("SELECT source AS book, count(*) AS sections, count(*) FILTER (text <> '') AS fetched, count(*) FILTER (text <> '' AND lang = 'en') AS ready FROM documents GROUP BY 1")
def docs_stats(spark, sf):
    return docs.doc_stats(V.sections(spark, sf))


@query(
    """SELECT doc_id AS id, 'doc:' || source || ':' || doc_id || '@' || h AS source, source AS book, doc_id::VARCHAR AS sec_id, h AS hash
FROM (SELECT *, substr(sha256(text), 1, 12) AS h FROM documents)"""
)
def section_sources(spark, sf):
    s = V.sections(spark, sf).select("id", X.section_source(F.col("book"), F.col("sec_id"), X.content_hash(F.col("orig_text"))).alias("source"))
    return s.select("id", "source", X.parse_section_source(F.col("source")).alias("p")).select("id", "source", "p.*")


@query(
    r"""SELECT b.item_id, d.doc_id FROM benchmark b JOIN (SELECT doc_id, lower(regexp_replace(text, '[[:space:]\x{3000}\x{a0}]', '', 'g')) AS body FROM documents) d
ON contains(d.body, lower(regexp_replace(b.text, '[[:space:]\x{3000}\x{a0}]', '', 'g')))"""
)
def evidence_match(spark, sf):
    quotes = V.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    return docs.quoted_in(quotes, V.table(spark, sf, "documents"))


@query("SELECT node_id, book, CAST(ord AS INT) AS ord FROM h", V.SQL_TERMS)
def concept_positions(spark, sf):
    return docs.concept_positions(V.terms(spark, sf), V.sections(spark, sf)).select("node_id", "book", "ord")


@query(
    """SELECT src, dst, CAST(CASE WHEN lo = hi THEN lo WHEN lo IS NOT NULL THEN 0 END AS INT) AS toc FROM (
  SELECT item_id AS src, item_id + 1 AS dst, (SELECT min(sign(b.ord - a.ord)) FROM h a JOIN h b USING (book) WHERE a.node_id = item_id AND b.node_id = item_id + 1) AS lo,
    (SELECT max(sign(b.ord - a.ord)) FROM h a JOIN h b USING (book) WHERE a.node_id = item_id AND b.node_id = item_id + 1) AS hi FROM benchmark)""",
    V.SQL_TERMS,
)
def toc_vote(spark, sf):
    pairs = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("src"), (F.col("item_id") + 1).alias("dst"))
    return docs.toc_vote(pairs, docs.concept_positions(V.terms(spark, sf), V.sections(spark, sf))).select("src", "dst", "toc")


@query("SELECT node_id, min_by(book, book) AS book FROM h GROUP BY 1", V.SQL_TERMS)
def section_for_node(spark, sf):
    return docs.section_for_node(V.terms(spark, sf), V.sections(spark, sf)).select("node_id", "book")


@query(
    """SELECT doc_id, length(text) AS n_chars, text = '' OR text IS NULL AS is_empty, count(*) OVER (PARTITION BY lower(trim(text))) AS copies, min(doc_id) OVER (PARTITION BY lower(trim(text))) AS first_id FROM documents"""
)
def exact_duplicates(spark, sf):
    d = V.table(spark, sf, "documents")
    key = F.sha2(F.lower(F.trim("text")), 256)
    groups = d.groupBy(key.alias("key")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), (F.coalesce("text", F.lit("")) == "").alias("is_empty"), key.alias("own")).join(groups, F.col("own").eqNullSafe(F.col("key"))).drop("own", "key")


@query()
def section_chunks(spark, sf):
    small_batches(spark)
    rows = V.sections(spark, sf).select("id", F.posexplode(U.split_chunks("orig_text")).alias("pos", "chunk"))
    return rows.select("id", "pos", F.length("chunk").alias("n_chars"), X.content_hash(F.col("chunk")).alias("hash"))


@query()
def picked_blocks(spark, sf):
    rows = V.sections(spark, sf).select("id", "title", F.col("orig_text").alias("text"), F.array("orig_lang").alias("focus"))
    out = ingest.picked_blocks(rows, F.col("focus"))
    return out.select("id", "pos", "n_blocks", F.length("block").alias("n_chars"))


@query()
def similar_titles(spark, sf):
    """Page titles that are alike; a pair is compared if it shares a word."""
    return titles.similar_titles(V.pages(spark, sf))


# --- vectors ---------------------------------------------------------------------------------

VECTORS_SQL = """v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id)"""


@query("SELECT a, b, round(sim, 6) AS similarity FROM s WHERE a < b AND sim >= 0.4", VECTORS_SQL)
def embedding_pairs(spark, sf):
    v = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dedup.similar_pairs(v, 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT query_id, node_id, round(sim, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT a AS query_id, b AS node_id, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM s WHERE sim >= 0.3) WHERE rank <= 3", VECTORS_SQL)
def embedding_top3(spark, sf):
    v = V.table(spark, sf, "embeddings")
    n = v.select(F.col("vec_id").alias("id"), F.lit("seed").alias("status"), "embedding")
    out = dedup.vector_candidates(v.select(F.col("vec_id").alias("query_id"), "embedding"), n, 0.3, 3, others_only=True)
    return out.withColumn("similarity", F.round("similarity", 6))


# --- review log and calibration --------------------------------------------------------------


@query("SELECT item_type, item_id, action, id FROM first WHERE decided_by = 'human'", V.SQL_LOG)
def first_decisions(spark, sf):
    return calibrate.first_decisions(V.review_log(spark, sf)).select("item_type", "item_id", "action", "id")


@query("SELECT item_type, item_id, max_by(action, (created_at, id)) AS audit FROM g WHERE action IN ('audit_confirm', 'audit_reject') GROUP BY 1, 2", V.SQL_LOG)
def last_audits(spark, sf):
    return calibrate.last_audits(V.review_log(spark, sf))


@query("SELECT id, max(id) OVER (PARTITION BY item_type, item_id) > id AS has_later FROM g", V.SQL_LOG)
def later_decision(spark, sf):
    return decisions.later_decision(V.review_log(spark, sf)).select("id", "has_later")


@query("SELECT id FROM g WHERE decided_by = 'auto' AND action = 'approve' AND NOT EXISTS (SELECT 1 FROM g h WHERE h.item_type = g.item_type AND h.item_id = g.item_id AND starts_with(h.action, 'audit_'))", V.SQL_LOG)
def unaudited_approvals(spark, sf):
    return calibrate.unaudited(V.review_log(spark, sf)).select("id")


@query("SELECT batch_id, count(*) AS decisions, count(*) FILTER (action = 'approve') AS approves, count(*) FILTER (action = 'reject') AS rejects, min(created_at) AS started FROM g WHERE decided_by = 'auto' GROUP BY 1", V.SQL_LOG)
def review_batches(spark, sf):
    return calibrate.batches(V.review_log(spark, sf))


@query("SELECT CASE WHEN source LIKE 'mine:%' THEN source ELSE channel END AS channel, decided_by, action, count(*) AS n FROM ch GROUP BY ALL", V.SQL_LOG)
def log_counts(spark, sf):
    return calibrate.log_counts(V.review_log(spark, sf))


BUCKET_SQL = """CASE WHEN s.item_type IS NULL THEN '无信号' ELSE coalesce(nullif(concat_ws('+',
  nullif(CASE WHEN s.is_edge THEN concat_ws('+', CASE WHEN ahead AND back THEN '互链' WHEN ahead OR back THEN '单向链' END, CASE WHEN refd > 0 THEN 'refd↑' WHEN refd < 0 THEN 'refd↓' END,
    CASE WHEN toc > 0 THEN 'toc↑' WHEN toc < 0 THEN 'toc↓' END, CASE WHEN wikidata THEN 'wikidata' END) ELSE concat_ws('+', CASE WHEN has_page THEN '有页' END, CASE WHEN exact_title THEN '精确命中' END) END, ''),
  'LLM:' || CASE verdict WHEN '支持(方向存疑)' THEN '支持(方向?)' WHEN '应为facet→x' THEN '应为facet' ELSE verdict END), ''), '无信号') END"""


@query(
    f"""SELECT *, approve + reject AS n, CASE WHEN approve + reject > 0 THEN round(approve / (approve + reject), 6) END AS precision FROM (
  SELECT f.channel, CASE WHEN f.item_type = 'edge' THEN coalesce(e.type, '?') ELSE 'node' END AS kind, {BUCKET_SQL} AS bucket,
    count(*) FILTER (f.action = 'approve') AS approve, count(*) FILTER (f.action = 'reject') AS reject, count(*) FILTER (f.action NOT IN ('approve', 'reject')) AS other
  FROM first f LEFT JOIN e ON f.item_type = 'edge' AND e.id = f.item_id LEFT JOIN s ON s.item_type = f.item_type AND s.item_id = f.item_id
  WHERE f.decided_by = 'human' AND NOT starts_with(f.action, 'audit_') GROUP BY ALL)""",
    V.SQL_SIGNALS, V.SQL_LOG,
)
def human_precision(spark, sf):
    out = calibrate.human_precision(V.review_log(spark, sf), V.edges(spark, sf), V.signals(spark, sf))
    return out.withColumn("precision", F.round("precision", 6))


@query(
    """SELECT channel, count(*) AS approved, count(audit) AS audited, CASE WHEN count(audit) > 0 THEN round(count(*) FILTER (audit = 'audit_reject') / count(audit), 6) END AS overturn
FROM first f LEFT JOIN (SELECT item_type, item_id, max_by(action, (created_at, id)) AS audit FROM g WHERE action IN ('audit_confirm', 'audit_reject') GROUP BY 1, 2) a USING (item_type, item_id)
WHERE decided_by = 'auto' AND action = 'approve' GROUP BY 1""",
    V.SQL_LOG,
)
def auto_overturn(spark, sf):
    return calibrate.auto_overturn(V.review_log(spark, sf)).withColumn("overturn", F.round("overturn", 6))


@query(
    """SELECT *, CASE WHEN agree + disagree + modified > 0 THEN round(agree / (agree + disagree + modified), 6) END AS agreement FROM (
  SELECT CASE WHEN starts_with(x.source, 'wikidata') THEN 'wikidata' WHEN starts_with(x.source, 'doc:') THEN 'doc:book1' WHEN starts_with(x.source, 'wiki:') THEN 'ingest/expand' WHEN starts_with(x.source, 'mine:') THEN 'mine:category' ELSE x.source END AS channel,
    s.item_type AS kind, count(*) AS shadow, count(*) FILTER (f.action = would) AS agree, count(*) FILTER (f.action IN ('approve', 'reject') AND f.action <> would) AS disagree,
    count(*) FILTER (f.action IS NOT NULL AND f.action NOT IN ('approve', 'reject')) AS modified, count(*) FILTER (f.action IS NULL) AS pending
  FROM s JOIN (SELECT 'node' AS item_type, id AS item_id, source FROM n UNION ALL SELECT 'edge', id, source FROM e) x USING (item_type, item_id)
  LEFT JOIN (SELECT * FROM first WHERE decided_by = 'human' AND NOT starts_with(action, 'audit_')) f USING (item_type, item_id) WHERE would IS NOT NULL GROUP BY ALL)""",
    V.SQL_SIGNALS, V.SQL_LOG,
)
def shadow_agreement(spark, sf):
    items = V.nodes(spark, sf).select(F.lit("node").alias("item_type"), F.col("id").alias("item_id"), "source").union(V.edges(spark, sf).select(F.lit("edge"), "id", "source"))
    return calibrate.shadow_agreement(V.review_log(spark, sf), V.signals(spark, sf), items).withColumn("agreement", F.round("agreement", 6))


@query(
    """, b AS (
  SELECT item_type, item_id, max(id) = max(last) AS back FROM (SELECT *, max(id) OVER (PARTITION BY item_type, item_id) AS last FROM g) WHERE batch_id = '2024-01-02' AND decided_by = 'auto' AND action IN ('approve', 'reject') GROUP BY 1, 2)
SELECT item_type, item_id, CASE WHEN back THEN 'reverted' ELSE 'skipped' END AS outcome FROM b
UNION ALL SELECT DISTINCT 'edge', e.id, 'cascaded' FROM e JOIN b ON b.item_type = 'node' AND b.back AND b.item_id IN (e.src, e.dst)
WHERE e.status = 'approved' AND NOT EXISTS (SELECT 1 FROM b x WHERE x.item_type = 'edge' AND x.back AND x.item_id = e.id)""",
    V.SQL_EDGES, V.SQL_LOG,
)
def rollback_batch(spark, sf):
    nodes, edges, log = V.nodes(spark, sf), V.edges(spark, sf), V.review_log(spark, sf)
    return decisions.rollback(nodes, edges, log, "2024-01-02")


# --- signals and adjudication ----------------------------------------------------------------

SUPPORT_SQL = "(wikidata OR ahead OR back OR coalesce(toc, 0) > 0)"
OPPOSE_SQL = "(e.type = 'prerequisite_of' AND (coalesce(refd, 0) < 0 OR coalesce(toc, 0) < 0))"
SHOWN_SQL = """shown AS (
  SELECT id FROM n WHERE status IN ('seed', 'approved'))"""


TRIAGE_SQL = f"""tr AS (
  SELECT s.item_type, s.item_id, CAST(CASE
    WHEN verdict IS NULL THEN 1 WHEN NOT is_edge THEN CASE WHEN starts_with(verdict, '应为facet') THEN 0 WHEN has_page AND exact_title AND NOT overlap THEN 0 WHEN has_page AND exact_title THEN 2 ELSE 0 END
    WHEN contains(verdict, '方向存疑') OR (starts_with(verdict, '支持') AND {OPPOSE_SQL}) OR (starts_with(verdict, '不支持') AND {SUPPORT_SQL}) THEN 0 WHEN starts_with(verdict, '证据不足') THEN 1 ELSE 2 END AS INT) AS tier
FROM s LEFT JOIN e ON is_edge AND e.id = item_id WHERE NOT is_edge OR (e.src IN (FROM shown) AND e.dst IN (FROM shown)))"""


@query("SELECT * FROM tr", V.SQL_SIGNALS, SHOWN_SQL, TRIAGE_SQL)
def triage(spark, sf):
    return verify.triaged(V.nodes(spark, sf), V.edges(spark, sf), V.signals(spark, sf)).select("item_type", "item_id", "tier")


@query("SELECT item_type, tier, count(*) AS n FROM tr GROUP BY ALL", V.SQL_SIGNALS, SHOWN_SQL, TRIAGE_SQL)
def tier_summary(spark, sf):
    return verify.tier_summary(verify.triaged(V.nodes(spark, sf), V.edges(spark, sf), V.signals(spark, sf)))


@query(
    """, ok AS (
  SELECT id FROM n WHERE status <> 'rejected')
SELECT DISTINCT p.id AS node_id, e.id AS edge_id FROM e JOIN n p ON p.status = 'proposed' AND p.id IN (e.src, e.dst)
WHERE e.status = 'proposed' AND e.src IN (FROM ok) AND e.dst IN (FROM ok)""",
    V.SQL_NODES, V.SQL_EDGES,
)
def related_edges(spark, sf):
    """Edges that approving the proposed nodes would open for review."""
    n = V.nodes(spark, sf)
    return verify.related_edges(n, V.edges(spark, sf), n.where("status = 'proposed'"))


@query()
def signal_lines(spark, sf):
    return verify.triaged(V.nodes(spark, sf), V.edges(spark, sf), V.signals(spark, sf)).select("item_type", "item_id", "label", "hint")


@query(
    """SELECT 'node' AS item_type, id AS item_id FROM n JOIN s ON s.item_type = 'node' AND s.item_id = n.id WHERE n.status = 'proposed' AND verdict IS NULL
UNION ALL SELECT 'edge', e.id FROM e JOIN s ON is_edge AND s.item_id = e.id WHERE e.status = 'proposed' AND verdict IS NULL AND e.src IN (FROM shown) AND e.dst IN (FROM shown)""",
    V.SQL_SIGNALS, SHOWN_SQL,
)
def review_queue(spark, sf):
    return verify.review_queue(V.nodes(spark, sf), V.edges(spark, sf), V.signals(spark, sf))


@query(
    """SELECT n.id, CASE WHEN overlap THEN 'approve' ELSE 'hold' END AS decision FROM n JOIN s ON s.item_type = 'node' AND s.item_id = n.id
WHERE n.status = 'proposed' AND verdict = '独立概念' AND n.source <> 'note' AND has_page AND exact_title""",
    V.SQL_SIGNALS,
)
def auto_nodes(spark, sf):
    return verify.auto_nodes(V.nodes(spark, sf), V.signals(spark, sf))


@query(
    f"""SELECT e.id, CASE WHEN verdict = '支持' AND {SUPPORT_SQL} AND NOT {OPPOSE_SQL} THEN 'approve' ELSE 'reject' END AS decision FROM e JOIN s ON is_edge AND s.item_id = e.id
WHERE e.status = 'proposed' AND e.source <> 'note' AND e.src IN (FROM shown) AND e.dst IN (FROM shown) AND ((verdict = '支持' AND {SUPPORT_SQL} AND NOT {OPPOSE_SQL}) OR (verdict = '不支持' AND NOT {SUPPORT_SQL}))""",
    V.SQL_SIGNALS, SHOWN_SQL,
)
def eligible_edges(spark, sf):
    none = spark.createDataFrame([], "id long")
    return verify.eligible_edges(V.nodes(spark, sf), V.edges(spark, sf), V.signals(spark, sf), none).select("id", "decision")


@query()
def apply_auto(spark, sf):
    return verify.apply_auto(V.nodes(spark, sf), V.edges(spark, sf), V.signals(spark, sf))


# --- external items --------------------------------------------------------------------------

ITEMS_SQL = """qi AS (
  SELECT o_orderkey AS node_id, CASE WHEN o_orderkey % 10 = 0 THEN 'QC' || o_custkey ELSE 'Q' || o_orderkey END AS qid FROM orders),
own AS (
  SELECT qid, min(node_id) AS node_id FROM qi GROUP BY 1 HAVING count(*) = 1),
f AS (
  SELECT 'Q' || src AS qid, CASE id % 3 WHEN 0 THEN 'P279' WHEN 1 THEN 'P361' ELSE 'P737' END AS prop, 'Q' || dst AS target FROM e)"""


@query("SELECT qid, string_agg(node_id, '|' ORDER BY node_id) AS nodes FROM qi GROUP BY 1 HAVING count(*) > 1", V.SQL_EDGES, ITEMS_SQL)
def shared_items(spark, sf):
    qids, _ = V.claims(spark, sf)
    return mining.shared_qids(qids).select("qid", text_list(F.col("nodes").cast("array<string>")).alias("nodes"))


@query(
    """SELECT DISTINCT CASE WHEN prop = 'P737' THEN b.node_id ELSE a.node_id END AS src, CASE WHEN prop = 'P737' THEN a.node_id ELSE b.node_id END AS dst,
  CASE prop WHEN 'P279' THEN 'is_a' WHEN 'P361' THEN 'part_of' ELSE 'related_to' END AS type, 'wikidata:' || prop AS source
FROM f JOIN own a ON a.qid = f.qid JOIN own b ON b.qid = f.target WHERE a.node_id <> b.node_id""",
    V.SQL_EDGES, ITEMS_SQL,
)
def claim_edges(spark, sf):
    qids, claims = V.claims(spark, sf)
    return mining.claim_edges(V.nodes(spark, sf), qids, claims).select("src", "dst", "type", "source")


@query(
    """SELECT f.target AS qid, min(own.node_id) AS child_id FROM f JOIN own ON own.qid = f.qid WHERE prop <> 'P737' AND f.target NOT IN (SELECT qid FROM own) GROUP BY 1""",
    V.SQL_EDGES, ITEMS_SQL,
)
def spine_targets(spark, sf):
    qids, claims = V.claims(spark, sf)
    return mining.spine_targets(V.nodes(spark, sf), qids, claims)


@query(
    """SELECT x.src, x.dst, string_agg(x.p || CASE x.way WHEN 0 THEN ' a→b' ELSE ' b→a' END, ',' ORDER BY x.p, x.way) AS relations FROM (
  SELECT DISTINCT e.src, e.dst, f.prop AS p, 0 AS way FROM e JOIN f ON f.qid = 'Q' || e.src AND f.target = 'Q' || e.dst
  UNION SELECT e.src, e.dst, f.prop, 1 FROM e JOIN f ON f.qid = 'Q' || e.dst AND f.target = 'Q' || e.src) x GROUP BY 1, 2""",
    V.SQL_EDGES, ITEMS_SQL,
)
def item_relations(spark, sf):
    _, claims = V.claims(spark, sf)
    q = lambda c: F.concat(F.lit("Q"), F.col(c).cast("string"))
    pairs = V.edges(spark, sf).select("src", "dst", q("src").alias("qid_a"), q("dst").alias("qid_b")).distinct()
    return mining.relation_between(pairs, claims).where("relations IS NOT NULL").select("src", "dst", F.array_join("relations", ",").alias("relations"))


@query("SELECT id, CASE WHEN n.source = 'note' THEN 'low' WHEN starts_with(n.source, 'doc:') THEN 'high' ELSE 'mid' END AS tier, CASE WHEN n.source = 'note' THEN 'note' WHEN starts_with(n.source, 'doc:') THEN 'doc:book1' WHEN starts_with(n.source, 'wiki:') THEN 'ingest/expand' ELSE 'mine:category' END AS channel FROM n", V.SQL_NODES)
def source_tiers(spark, sf):
    s = F.col("source")
    return V.nodes(spark, sf).select("id", R.source_tier(s).alias("tier"), R.channel(s).alias("channel"))


@query("SELECT o_orderkey AS query_id, 'o-' || o_orderkey AS name, o_orderkey AS node_id, 'exact' AS how FROM orders")
def resolve_names(spark, sf):
    """Every alias in another case finds its node in the first stage of entity resolution."""
    n = V.nodes(spark, sf)
    asked = n.select(F.col("id").alias("query_id"), F.lower(F.element_at("aliases", 1)).alias("name"), F.lit(None).cast("array<float>").alias("embedding"))
    p = V.pages(spark, sf)
    none = spark.createDataFrame([], "query_id long, node_id long, relation string")
    return dedup.cascade(asked, n, p, N.title_index(p, V.LANGUAGES), none)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: which visible concepts have no edge."""
    return QUERIES["orphans"](spark, sf_dir)
