"""Queries over signals, decisions, ingestion and stored tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators import calibrate, corpus, decisions, docs, export, graph, ingest, mining, verify
from ..sources import catalog
from . import views as V
from .queries import SHOWN_SQL, query, text_list

ITEM = ["item_type", "item_id"]


def _pick(key, *values):
    """The value at ``key``, an expression from 0 to len(values) - 1."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


# --- stored tables ---------------------------------------------------------------------------


@query("SELECT id, name, alias AS aliases, facet || '|误区:' || id AS facets FROM n WHERE status = 'proposed'", V.SQL_NODES)
def stored_nodes(spark, sf):
    """Proposed nodes, written to a catalog twice and read back."""
    store = catalog.Catalog(spark, graph.work_path(spark, "catalog"))
    n = V.nodes(spark, sf)
    store.replace("nodes", n.where("status <> 'proposed'"))
    store.replace("nodes", n)
    return catalog.list_nodes(store.read("nodes"), "proposed").select("id", "name", text_list(F.col("aliases")).alias("aliases"), text_list(F.col("facets")).alias("facets"))


@query("SELECT id, src, dst, type FROM e WHERE status = 'proposed' AND type = 'is_a'", V.SQL_EDGES)
def stored_edges(spark, sf):
    """Proposed is_a edges of a catalog that was written in two parts."""
    store = catalog.Catalog(spark, graph.work_path(spark, "catalog"))
    e = V.edges(spark, sf)
    store.replace("edges", e.where("id % 2 = 0"))
    store.append("edges", e.where("id % 2 <> 0"))
    return catalog.list_edges(store.read("edges"), "proposed", "is_a").select("id", "src", "dst", "type")


@query(
    """, a AS (
  SELECT page_id AS id, lang, page_id, title FROM p UNION ALL SELECT page_id + 1000000000, lang, page_id, CASE WHEN page_id % 4 = 0 THEN title || ' 2' ELSE title END FROM p WHERE page_id % 2 = 0),
b AS (
  SELECT *, row_number() OVER (PARTITION BY lang, page_id ORDER BY id DESC) AS nth FROM a)
SELECT id, lang, page_id, title FROM (SELECT *, row_number() OVER (PARTITION BY lang, title ORDER BY id DESC) AS nth2 FROM b WHERE nth = 1) WHERE nth2 = 1""",
    V.SQL_PAGES,
)
def latest_pages(spark, sf):
    """Pages after every second was fetched again, some of them under another title."""
    p = V.pages(spark, sf)
    again = p.where("page_id % 2 = 0").withColumn("id", F.col("id") + 1000000000).withColumn("title", F.when(F.col("page_id") % 4 == 0, F.concat("title", F.lit(" 2"))).otherwise(F.col("title")))
    return corpus.latest_pages(p, again).select("id", "lang", "page_id", "title")


@query("SELECT page_id, page_id % 4 = 0 AS is_disambiguation FROM p", V.SQL_PAGES)
def disambiguation_pages(spark, sf):
    p = V.pages(spark, sf).withColumn("categories", F.when(F.col("page_id") % 4 == 0, F.array(F.lit("x"), F.lit("All Disambiguation pages"))).otherwise(F.col("categories")))
    return corpus.disambiguation(p).select("page_id", "is_disambiguation")


@query("SELECT doc_id AS id, 'Section ' || doc_id AS core FROM documents")
def section_title_cores(spark, sf):
    return V.sections(spark, sf).select("id", X.title_core(F.col("title")).alias("core"))


# --- items of pages --------------------------------------------------------------------------

PAGE_ITEMS_SQL = """pq AS (
  SELECT lang, page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Q' || page_id % 40 END AS qid FROM p WHERE page_id % 3 <> 0)"""


def _page_items(spark, sf):
    qid = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("Q"), (F.col("page_id") % 40).cast("string")))
    return V.pages(spark, sf).where("page_id % 3 <> 0").select("lang", "page_id", qid.alias("qid"))


def _mapped(spark, sf):
    from .queries import page_for_node

    return page_for_node(spark, sf)


@query("SELECT DISTINCT m.lang, m.page_id FROM m WHERE NOT EXISTS (SELECT 1 FROM pq WHERE pq.lang = m.lang AND pq.page_id = m.page_id)", V.SQL_PAGES, PAGE_ITEMS_SQL)
def missing_items(spark, sf):
    return mining.missing_qids(_mapped(spark, sf), _page_items(spark, sf))


@query("SELECT DISTINCT qid FROM pq WHERE qid <> '' AND CAST(substr(qid, 2) AS INT) % 2 = 1", V.SQL_PAGES, PAGE_ITEMS_SQL)
def missing_claims(spark, sf):
    """Items without fetched claims, where those with even numbers have some."""
    items = _page_items(spark, sf)
    known = items.where("qid <> '' AND int(substring(qid, 2)) % 2 = 0").select("qid").distinct()
    return mining.missing_claims(items, known)


@query("SELECT m.node_id, pq.qid FROM m JOIN pq USING (lang, page_id) WHERE qid <> ''", V.SQL_PAGES, PAGE_ITEMS_SQL)
def node_items(spark, sf):
    return mining.node_qids(V.page_nodes(spark, sf), _mapped(spark, sf), _page_items(spark, sf))


# --- structural signals ----------------------------------------------------------------------

# An edge for each page, from its first linked word to its second.
PAGE_EDGES_SQL = """pe AS (
  SELECT p.page_id AS id, a.id AS src, b.id AS dst FROM p JOIN w a ON a.name = lower(p.links[1]) JOIN w b ON b.name = lower(p.links[2]) WHERE a.id <> b.id),
tg AS (
  SELECT id AS node_id, name AS t FROM w UNION SELECT id, name || 's' FROM w UNION SELECT m.node_id, k.key FROM m JOIN k ON k.lang = m.lang AND k.page_id = m.page_id),
lk AS (
  SELECT DISTINCT node_id, lower(link) AS t FROM (SELECT m.node_id, unnest(p.links) AS link FROM m JOIN p ON p.lang = m.lang AND p.page_id = m.page_id)),
ln AS (
  SELECT DISTINCT lk.node_id AS a, tg.node_id AS b FROM lk JOIN tg ON tg.t = lk.t)"""


def page_edges(spark, sf, status="proposed"):
    w = V.page_nodes(spark, sf).select("id", "name")
    ends = V.pages(spark, sf).where(F.size("links") > 1).select(F.col("page_id").alias("id"), F.lower(F.col("links")[0]).alias("a"), F.lower(F.col("links")[1]).alias("b"))
    rows = ends.join(w.select(F.col("name").alias("a"), F.col("id").alias("src")), "a").join(w.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b").where("src <> dst")
    return S.conform(rows.select("id", "src", "dst", F.lit("prerequisite_of").alias("type"), F.lit(status).alias("status")), S.EDGES)


@query(
    """, mp AS (
  SELECT DISTINCT node_id FROM m),
cl AS (
  SELECT DISTINCT src, dst FROM pe WHERE id % 3 = 0),
x AS (
  SELECT pe.id, CASE WHEN both_mapped THEN EXISTS (SELECT 1 FROM ln WHERE ln.a = pe.src AND ln.b = pe.dst) END AS ahead, CASE WHEN both_mapped THEN EXISTS (SELECT 1 FROM ln WHERE ln.a = pe.dst AND ln.b = pe.src) END AS back,
    concat_ws('，', CASE WHEN EXISTS (SELECT 1 FROM cl WHERE cl.src = pe.src AND cl.dst = pe.dst) THEN 'P279 src→dst' END, CASE WHEN EXISTS (SELECT 1 FROM cl WHERE cl.src = pe.dst AND cl.dst = pe.src) THEN 'P279 dst→src' END) AS told
  FROM (SELECT *, src IN (SELECT node_id FROM mp) AND dst IN (SELECT node_id FROM mp) AS both_mapped FROM pe) pe)
SELECT id AS item_id, ahead, back, CAST(back AS INT) - CAST(ahead AS INT) AS refd, nullif(told, '') AS wikidata FROM x WHERE ahead IS NOT NULL OR told <> ''""",
    V.SQL_PAGES, PAGE_EDGES_SQL,
)
def edge_signals(spark, sf):
    """Links between pages, the direction they speak for, and claims of every third edge."""
    n, e = V.page_nodes(spark, sf), page_edges(spark, sf)
    item = lambda c: F.concat(F.lit("Q"), F.col(c).cast("string"))
    qids = n.select(F.col("id").alias("node_id"), item("id").alias("qid"))
    claims = e.where("id % 3 = 0").groupBy(item("src").alias("qid")).agg(F.create_map(F.lit("P279"), F.collect_set(item("dst"))).alias("claims"))
    positions = spark.createDataFrame([], "node_id long, book string, ord int")
    out = verify.edge_signals(n, e, V.pages(spark, sf), _mapped(spark, sf), positions, qids, claims)
    s = lambda c, name: F.col(f"signals.{c}").alias(name)
    return out.select("item_id", s("link_src_dst", "ahead"), s("link_dst_src", "back"), s("refd", "refd"), s("wikidata", "wikidata"))


@query(
    r""", nb AS (
  SELECT src AS node_id, dst AS other FROM pe UNION SELECT dst, src FROM pe),
nm AS (
  SELECT nb.node_id, x.name FROM nb JOIN (SELECT id, name FROM w UNION ALL SELECT id, name || 's' FROM w) x ON x.id = nb.other WHERE length(x.name) >= 3),
ov AS (
  SELECT DISTINCT nm.node_id FROM nm JOIN m ON m.node_id = nm.node_id JOIN p ON p.lang = m.lang AND p.page_id = m.page_id
  WHERE list_contains(list_transform(p.links, lambda q: lower(q)), nm.name) OR CASE WHEN regexp_full_match(nm.name, '[\x00-\x7f]+') THEN regexp_matches(lower(p.text), '(^|[^\pL\pN_])' || regexp_escape(nm.name) || '([^\pL\pN_]|$)')
    ELSE contains(lower(regexp_replace(p.text, '[[:space:]\x{3000}\x{a0}]', '', 'g')), nm.name) END)
SELECT w.id AS item_id, m.node_id IS NOT NULL AS has_page, CASE WHEN m.node_id IS NOT NULL THEN EXISTS (SELECT 1 FROM k WHERE k.lang = m.lang AND k.page_id = m.page_id AND k.key IN (w.name, w.name || 's')) END AS exact_title,
  CASE WHEN m.node_id IS NOT NULL THEN w.id IN (SELECT node_id FROM ov) END AS neighbor_overlap FROM w LEFT JOIN m ON m.node_id = w.id""",
    V.SQL_PAGES, PAGE_EDGES_SQL,
)
def node_signals(spark, sf):
    """Pages, exact titles and overlap with neighbours of proposed words."""
    n = V.page_nodes(spark, sf).withColumn("status", F.lit("proposed"))
    out = verify.node_signals(n, page_edges(spark, sf), V.pages(spark, sf), _mapped(spark, sf))
    return out.select("item_id", "signals.has_page", "signals.exact_title", "signals.neighbor_overlap")


@query("SELECT w.id AS node_id, CASE WHEN m.node_id IS NULL THEN '（无语料页）' ELSE substr(p.text, 1, 400) END AS head FROM w LEFT JOIN m ON m.node_id = w.id LEFT JOIN p ON p.lang = m.lang AND p.page_id = m.page_id", V.SQL_PAGES)
def page_heads(spark, sf):
    return verify.page_heads(V.page_nodes(spark, sf), V.pages(spark, sf), _mapped(spark, sf))


@query(
    """, d AS (
  SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id, id FROM pe UNION SELECT dst, id FROM pe) GROUP BY 1)
SELECT m.node_id, w.name, sum(coalesce(c.n, 0)) / (1 + coalesce(any_value(d.degree), 0))::DOUBLE AS score, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS indegree
FROM m JOIN w ON w.id = m.node_id JOIN k ON k.lang = m.lang AND k.page_id = m.page_id LEFT JOIN c ON c.lang = k.lang AND c.title = k.key LEFT JOIN d ON d.node_id = m.node_id
WHERE m.node_id % 2 <> 0 GROUP BY 1, 2 ORDER BY score DESC, m.node_id LIMIT 30""",
    V.SQL_PAGES, PAGE_EDGES_SQL,
)
def unread_anchors(spark, sf):
    """Anchors by links per edge; pages of words with even ids were read in this revision, some others in an older one."""
    n, p, m = V.page_nodes(spark, sf), V.pages(spark, sf), _mapped(spark, sf)
    revision = F.col("revision_id") - F.when(F.col("node_id") % 2 == 0, 0).otherwise(1)
    read = m.join(p.select("lang", "page_id", "title", "revision_id"), ["lang", "page_id"]).join(n.select(F.col("id").alias("node_id"), "name"), "node_id")
    log = S.conform(read.select(F.col("name").alias("anchor"), X.page_source(F.col("lang"), F.col("title"), revision).alias("source")), S.INGEST_LOG)
    return corpus.anchor_queue(n, page_edges(spark, sf, "seed"), p, log, 30, m)


# --- sections --------------------------------------------------------------------------------


@query(
    """, best AS (
  SELECT node_id, min(book) AS book, min_by(ord, book) AS ord FROM h GROUP BY 1)
SELECT best.node_id, x.name, best.book, best.ord::VARCHAR AS sec_id, 'body' AS how, 1.0 / (1 + (CASE WHEN best.node_id + 1 IN (SELECT item_id FROM benchmark) THEN 1 ELSE 0 END) + (CASE WHEN best.node_id - 1 IN (SELECT item_id FROM benchmark) THEN 1 ELSE 0 END))::DOUBLE AS score
FROM best JOIN x ON x.node_id = best.node_id WHERE best.node_id % 3 <> 0 ORDER BY score DESC, best.node_id LIMIT 30""",
    V.SQL_TERMS,
)
def unread_section_anchors(spark, sf):
    """Concepts best told by a section; every third was read in this version, the next third in another one."""
    t, s = V.terms(spark, sf), V.sections(spark, sf)
    ids = t.select("id")
    chain = ids.join(ids.select((F.col("id") - 1).alias("id")), "id").select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("is_a").alias("type"), F.lit("seed").alias("status"))
    read = docs.section_for_node(t, s).join(s.select("book", "ord", "sec_id", "content_hash"), ["book", "ord"]).join(t.select(F.col("id").alias("node_id"), "name"), "node_id").where("node_id % 3 <> 2")
    version = F.when(F.col("node_id") % 3 == 0, F.col("content_hash")).otherwise(F.lit("0123456789ab"))
    log = S.conform(read.select(F.col("name").alias("anchor"), X.section_source(F.col("book"), F.col("sec_id"), version).alias("source")), S.INGEST_LOG)
    return docs.anchor_queue(t, S.conform(chain, S.EDGES), s, log, 30)


@query(
    """SELECT h.node_id, 2 AS rank, 'doc' AS kind, h.book, h.ord || ' Section ' || h.ord AS title, 'http://x/' || h.ord AS url FROM h
UNION ALL SELECT x.node_id, 1, 'wiki', NULL, title, 'https://' || lang || '.wikipedia.org/wiki/' || replace(title, ' ', '_') FROM x JOIN p ON p.page_id = x.node_id""",
    V.SQL_TERMS, V.SQL_PAGES,
)
def resources(spark, sf):
    """Where to read about each concept: mentions in sections, and the page of its number."""
    t, p = V.terms(spark, sf), V.pages(spark, sf)
    mapped = t.select(F.col("id").alias("node_id"), F.col("id").alias("page_id")).join(p.select("lang", "page_id"), "page_id").select("node_id", "lang", "page_id")
    return export.resources(t, V.sections(spark, sf), p, mapped)


@query(
    r"""WITH q AS (
  SELECT doc_id, text, regexp_extract(text, '[a-z]{6,}') AS probe FROM documents WHERE lang = 'en' AND text <> ''),
a AS (
  SELECT *, CASE WHEN probe <> '' THEN instr(text, substr(probe, 1, 20)) ELSE 0 END AS pos FROM q)
SELECT doc_id, doc_id % 2 = 1 AS drifted, CASE WHEN pos > 0 THEN substr(text, greatest(1, pos - 500), pos + length(probe) + 500 - greatest(1, pos - 500)) ELSE substr(text, 1, 1000) END AS excerpt FROM a"""
)
def source_excerpts(spark, sf):
    """Text around a quotation of each English section; every second one is quoted from another version."""
    s = V.sections(spark, sf).where("coalesce(text, '') <> ''")
    version = F.when(F.col("id") % 2 == 1, F.lit("0123456789ab")).otherwise(F.col("content_hash"))
    items = s.select(F.col("id").alias("doc_id"), X.section_source(F.col("book"), F.col("sec_id"), version).alias("source"), F.concat(F.lit("[推断] "), F.regexp_extract("text", "[a-z]{6,}", 0)).alias("evidence"))
    return verify.source_excerpts(items, V.pages(spark, sf), s).select("doc_id", "drifted", "excerpt")


# --- from answers to nodes and edges ---------------------------------------------------------


@query(
    """SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY pos, place) AS INT) AS nth, name FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lower(name) ORDER BY pos, place) AS again FROM (
    SELECT conv_id AS source, turn AS pos, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS place FROM conversations)) WHERE again = 1
QUALIFY nth <= 12"""
)
def answered_concepts(spark, sf):
    """The first 12 different words of each conversation, as concepts of a JSON answer for each turn."""
    return ingest.concepts(_answers(spark, sf), 12).select("source", F.col("nth").cast("int").alias("nth"), "name")


def _answers(spark, sf):
    words = F.coalesce(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.array().cast("array<string>"))
    answer = F.struct(F.transform(words, lambda x: F.struct(x.alias("name"))).alias("concepts"), words.alias("anchor_facets"))
    return ingest.parsed(V.table(spark, sf, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("pos"), F.to_json(answer).alias("answer")))


@query(
    """, f AS (
  SELECT source, name, min(pos * 1000000 + place) AS first_place FROM (
    SELECT conv_id AS source, turn AS pos, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS place FROM conversations) WHERE length(name) <= 16 GROUP BY ALL),
g AS (
  SELECT source + 1 AS id, string_agg(name, '|' ORDER BY first_place) AS names FROM f GROUP BY 1)
SELECT n.id, n.facet || '|误区:' || n.id || coalesce('|' || g.names, '') AS facets FROM n LEFT JOIN g ON g.id = n.id""",
    V.SQL_NODES,
)
def anchor_facets(spark, sf):
    """Facets of nodes after the words of a conversation were added to one each."""
    answers = _answers(spark, sf)
    anchors = answers.select("source", (F.col("source") + 1).alias("node_id")).distinct()
    return ingest.with_anchor_facets(V.nodes(spark, sf), answers, anchors).select("id", text_list(F.col("facets")).alias("facets"))


@query(
    """, f AS (
  SELECT n.id, 'o:' || n.id AS source, CASE n.id % 4 WHEN 0 THEN CASE WHEN x.status <> 'rejected' THEN x.id END WHEN 1 THEN x.id WHEN 2 THEN n.id END AS other,
    ['is_a', 'part_of', 'prerequisite_of', 'related_to', 'causes'][n.id % 5 + 1] AS type, CASE WHEN n.id % 3 = 0 THEN '同题替代' END AS kind, n.id % 2 = 0 AS guessed, n.id % 7 = 0 AS turned,
    CASE WHEN n.id % 10 = 9 THEN 0.5 ELSE n.id % 10 / 10 END AS confidence, CASE WHEN n.id % 11 = 0 THEN 'never said' ELSE 'comes AFTER…order ' || (n.id - 1) END AS evidence
  FROM n LEFT JOIN n x ON x.id = n.id - 1),
d AS (
  SELECT *, CASE WHEN other IS NULL OR other = id OR type = 'causes' THEN 'endpoint' WHEN id % 11 = 0 THEN 'evidence' WHEN type = 'related_to' AND kind IS NULL THEN 'kind' END AS dropped, type = 'prerequisite_of' AND guessed AS guess FROM f)
SELECT source, CASE WHEN turned THEN other ELSE id END AS src, CASE WHEN turned THEN id ELSE other END AS dst, type, CASE WHEN guess THEN least(confidence, 0.6) ELSE confidence END AS confidence, dropped, CASE WHEN type = 'related_to' AND kind IS NULL THEN '[] ' ELSE '' END || evidence AS bare,
  CASE WHEN type = 'related_to' THEN '[' || coalesce(kind, '') || '] ' WHEN guess THEN '[推断] ' ELSE '' END || evidence AS rationale FROM d""",
    V.SQL_NODES,
)
def edge_candidates(spark, sf):
    """An edge that each order's page names: admissible ends, grounded evidence, kinds, guesses and directions."""
    n = V.nodes(spark, sf)
    i, before = F.col("id"), (F.col("id") - 1).cast("string")
    edge = F.struct(
        F.when(i % 4 == 0, F.concat(F.lit("o-"), before)).when(i % 4 == 1, F.concat(F.lit("ORDER "), before)).when(i % 4 == 2, F.concat(F.lit(" Order "), i.cast("string"))).otherwise("nobody").alias("other"),
        _pick(i % 5, *S.EDGE_TYPES, "causes").alias("type"), F.when(i % 3 == 0, S.RELATED_KINDS[0]).alias("kind"), F.when(i % 2 == 0, "true").otherwise("false").alias("inferred"),
        F.when(i % 7 == 0, "other_to_new").otherwise("new_to_other").alias("direction"), F.when(i % 10 != 9, (i % 10) / F.lit(10.0)).alias("confidence"),
        F.when(i % 11 == 0, "never said").otherwise(F.concat(F.lit("comes AFTER…order "), before)).alias("evidence"),
    )
    source = F.concat(F.lit("o:"), i.cast("string"))
    found = n.select(source.alias("source"), "name", i.alias("node_id"), F.array(edge).alias("edges"))
    texts = n.select(source.alias("source"), F.concat(F.lit("This page: order "), i.cast("string"), F.lit(" comes  after\norder "), before, F.lit(".")).alias("text"))
    out = ingest.edge_candidates(found, texts, n)
    return out.select("source", "src", "dst", "type", "confidence", "dropped", X.without_tags(F.col("rationale")).alias("bare"), "rationale")


@query(
    """, c AS (
  SELECT trim(p_name) AS name, min('part:' || p_partkey) AS source FROM part GROUP BY 1),
d AS (
  SELECT name, row_number() OVER (ORDER BY source, name) + (SELECT max(id) FROM n) AS id FROM c WHERE name NOT IN (SELECT name FROM n))
SELECT id, name, 'proposed' AS status FROM d UNION ALL SELECT id, name, status FROM n""",
    V.SQL_NODES,
)
def added_nodes(spark, sf):
    """Nodes with one for each part name; names that nodes have already come in again and are left out."""
    n = V.nodes(spark, sf)
    new = V.table(spark, sf, "part").select("p_name", F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("source")).select(F.col("p_name").alias("name"), F.lit("").alias("definition"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("facets"), "source")
    again = n.select(F.concat(F.lit(" "), "name").alias("name"), "definition", "aliases", "facets", "source")
    return ingest.add_nodes(n, new.union(again), 0.0).select("id", "name", "status")


@query(
    """, b AS (
  SELECT DISTINCT dst AS src, src AS dst, type FROM e),
d AS (
  SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = b.src AND e.dst = b.dst AND e.type = b.type)
    AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = b.dst AND e.dst = b.src AND e.type = b.type AND e.type = 'related_to' AND e.status <> 'rejected')),
r AS (
  SELECT *, row_number() OVER (PARTITION BY type, CASE WHEN type = 'related_to' THEN least(src, dst) ELSE src END, CASE WHEN type = 'related_to' THEN greatest(src, dst) ELSE dst END ORDER BY src) AS nth FROM d),
z AS (
  SELECT row_number() OVER (ORDER BY src, dst, type) + (SELECT max(id) FROM e) AS id, src, dst, type FROM r WHERE nth = 1)
SELECT id, src, dst, type FROM e UNION ALL SELECT z.id, src, dst, z.type FROM z JOIN n a ON a.id = z.src JOIN n c ON c.id = z.dst WHERE a.type = 'concept' AND c.type = 'concept'""",
    V.SQL_NODES, V.SQL_EDGES,
)
def added_edges(spark, sf):
    """Edges with their reverses, but for duplicates and those with an end of a wrong type."""
    e = V.edges(spark, sf)
    turned = mining.candidate(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence", "rationale", "source"))
    return ingest.add_edges(e, V.nodes(spark, sf), turned, 0.0).select("id", "src", "dst", "type")


@query(
    """, l AS (
  SELECT id, name AS anchor, source FROM n WHERE id % 3 = 0)
SELECT id, anchor, source FROM l UNION ALL SELECT row_number() OVER (ORDER BY name, source) + (SELECT max(id) FROM l), name, source FROM n WHERE id % 3 <> 0""",
    V.SQL_NODES,
)
def ingest_logged(spark, sf):
    """The ingest log after all pages were read, every third for the second time."""
    rows = V.nodes(spark, sf).select("id", F.col("name").alias("anchor"), "source")
    return ingest.log_ingest(S.conform(rows.where("id % 3 = 0"), S.INGEST_LOG), rows, 0.0).select("id", "anchor", "source")


# --- decisions -------------------------------------------------------------------------------


@query(
    """, a AS (
  SELECT DISTINCT item_type, item_id FROM (SELECT item_type, item_id, max_by(action, (created_at, id)) AS audit FROM g WHERE action IN ('audit_confirm', 'audit_reject') GROUP BY 1, 2) WHERE audit = 'audit_reject'),
i AS (
  SELECT 'node' AS item_type, id AS item_id, status FROM n UNION ALL SELECT 'edge', id, status FROM e)
SELECT i.item_type, i.item_id, CASE WHEN a.item_id IS NOT NULL THEN 'rejected' ELSE status END AS status FROM i LEFT JOIN a USING (item_type, item_id)""",
    V.SQL_NODES, V.SQL_EDGES, V.SQL_LOG,
)
def audited_items(spark, sf):
    """Status of all nodes and edges after the last audits."""
    audits = calibrate.last_audits(V.review_log(spark, sf)).select(*ITEM, F.col("audit").alias("action"))
    nodes, edges = decisions.audited(V.nodes(spark, sf), V.edges(spark, sf), audits)
    return nodes.select(F.lit("node").alias("item_type"), F.col("id").alias("item_id"), "status").union(edges.select(F.lit("edge"), "id", "status"))


@query(
    """, a AS (
  SELECT DISTINCT item_type, item_id FROM g WHERE action IN ('audit_confirm', 'audit_reject'))
SELECT id, item_type, item_id, action FROM g UNION ALL SELECT row_number() OVER (ORDER BY item_type, item_id) + (SELECT max(id) FROM g), item_type, item_id, 'approve' FROM a""",
    V.SQL_LOG,
)
def appended_log(spark, sf):
    """The review log with an approval of every audited item, under the next ids."""
    log = V.review_log(spark, sf)
    new = calibrate.last_audits(log).select(*ITEM, F.lit("approve").alias("action"), F.lit("").alias("detail"), F.lit("note").alias("source"), F.lit("human").alias("decided_by"), F.lit("").alias("batch_id"), F.lit(0.0).alias("created_at"))
    return decisions.append_log(log, new).select("id", *ITEM, "action")


# Decisions on proposed nodes; merged and demoted ones name the node after them by its alias.
NODE_DECISIONS_SQL = """nd AS (
  SELECT n.id, n.name, ['approve', 'reject', 'merge', 'demote'][n.id % 4 + 1] AS action, t.id AS target FROM n LEFT JOIN n t ON t.id = n.id + 1 AND t.status <> 'rejected' WHERE n.status = 'proposed'),
vd AS (
  SELECT * FROM nd WHERE action IN ('approve', 'reject') OR target IS NOT NULL)"""


def _decided_nodes(spark, sf):
    n = V.nodes(spark, sf)
    asked = n.where("status = 'proposed'").select("id", _pick(F.col("id") % 4, "approve", "reject", "merge", "demote").alias("action"), F.concat(F.lit("o-"), (F.col("id") + 1).cast("string")).alias("target"))
    return decisions.decide_nodes(n, V.edges(spark, sf), asked)


@query(
    """SELECT n.id, CASE WHEN v.action = 'approve' THEN 'approved' WHEN v.action IS NOT NULL THEN 'rejected' ELSE n.status END AS status,
  n.alias || coalesce('|' || x.name, '') AS aliases, n.facet || '|误区:' || n.id || coalesce('|' || y.name, '') AS facets
FROM n LEFT JOIN vd v ON v.id = n.id LEFT JOIN vd x ON x.action = 'merge' AND x.target = n.id LEFT JOIN vd y ON y.action = 'demote' AND y.target = n.id""",
    V.SQL_NODES, NODE_DECISIONS_SQL,
)
def decided_nodes(spark, sf):
    return _decided_nodes(spark, sf)[0].select("id", "status", text_list(F.col("aliases")).alias("aliases"), text_list(F.col("facets")).alias("facets"))


@query(
    """, mv AS (
  SELECT e.id, coalesce(a.target, e.src) AS src, coalesce(b.target, e.dst) AS dst, e.status FROM e LEFT JOIN vd a ON a.action = 'merge' AND a.id = e.src LEFT JOIN vd b ON b.action = 'merge' AND b.id = e.dst),
gone AS (
  SELECT id FROM vd WHERE action IN ('reject', 'demote'))
SELECT id, src, dst, CASE WHEN status = 'proposed' AND (src IN (FROM gone) OR dst IN (FROM gone)) THEN 'rejected' ELSE status END AS status FROM mv""",
    V.SQL_NODES, V.SQL_EDGES, NODE_DECISIONS_SQL,
)
def edges_of_decided_nodes(spark, sf):
    return _decided_nodes(spark, sf)[1].select("id", "src", "dst", "status")


# Decisions on proposed edges: approve, reject, flip, and two of five are given another type.
EDGE_DECISIONS_SQL = """dd AS (
  SELECT *, ['approve', 'reject', 'flip', 'retype', 'retype'][(id // 20) % 5 + 1] AS action, ['is_a', 'part_of', 'prerequisite_of', 'related_to'][(id // 100) % 4 + 1] AS new_type, CASE WHEN (id // 20) % 2 = 0 THEN '演化启发' END AS kind FROM e WHERE status = 'proposed'),
ve AS (
  SELECT *, CASE WHEN action = 'flip' THEN dst ELSE src END AS to_src, CASE WHEN action = 'flip' THEN src ELSE dst END AS to_dst, CASE WHEN action = 'retype' THEN new_type ELSE type END AS to_type
  FROM dd WHERE action <> 'retype' OR (new_type <> type AND (new_type <> 'related_to' OR kind IS NOT NULL))),
ce AS (
  SELECT ve.*, (SELECT min(e.id) FROM e WHERE ve.action IN ('flip', 'retype') AND e.src = ve.to_src AND e.dst = ve.to_dst AND e.type = ve.to_type AND (ve.action = 'flip' OR e.id <> ve.id)) AS clash FROM ve)"""


def _decided_edges(spark, sf):
    e = V.edges(spark, sf)
    at = F.floor(F.col("id") / 20)
    asked = e.where("status = 'proposed'").select("id", _pick(at % 5, "approve", "reject", "flip", "retype", "retype").alias("action"), _pick(F.floor(F.col("id") / 100) % 4, *S.EDGE_TYPES).alias("new_type"), F.when(at % 2 == 0, S.RELATED_KINDS[1]).alias("kind"))
    return decisions.decide_edges(e, asked)


@query(
    """SELECT e.id, CASE WHEN c.clash IS NULL THEN coalesce(c.to_src, e.src) ELSE e.src END AS src, CASE WHEN c.clash IS NULL THEN coalesce(c.to_dst, e.dst) ELSE e.dst END AS dst, CASE WHEN c.clash IS NULL THEN coalesce(c.to_type, e.type) ELSE e.type END AS type,
  CASE WHEN c.id IS NULL THEN e.status WHEN c.action = 'reject' OR c.clash IS NOT NULL THEN 'rejected' ELSE 'approved' END AS status,
  CASE WHEN c.id IS NULL OR c.clash IS NOT NULL THEN '' WHEN c.action = 'flip' THEN '[人工翻转] ' WHEN c.action = 'retype' THEN '[人工改型 ' || e.type || '->' || c.new_type || '] ' || CASE WHEN c.new_type = 'related_to' THEN '[' || c.kind || '] ' ELSE '' END ELSE '' END AS rationale
FROM e LEFT JOIN ce c ON c.id = e.id""",
    V.SQL_EDGES, EDGE_DECISIONS_SQL,
)
def decided_edges(spark, sf):
    return _decided_edges(spark, sf)[0].select("id", "src", "dst", "type", "status", "rationale")


@query(
    "SELECT id, CASE WHEN clash IS NOT NULL THEN 'reject' ELSE action END AS outcome, CASE WHEN clash IS NOT NULL THEN 'id=' || clash WHEN action = 'retype' THEN type || '->' || new_type ELSE '' END AS detail FROM ce",
    V.SQL_EDGES, EDGE_DECISIONS_SQL,
)
def edge_outcomes(spark, sf):
    return _decided_edges(spark, sf)[1]


@query(
    """SELECT item_type, item_id, ahead AS link_src_dst, CASE WHEN item_id % 2 = 0 THEN 1 ELSE toc END AS toc, CASE WHEN item_id % 4 = 0 THEN '证据不足' ELSE verdict END AS llm_verdict FROM s
UNION ALL SELECT item_type, -1 - item_id, NULL, 1, CASE WHEN item_id % 4 = 0 THEN '证据不足' END FROM s WHERE item_id % 2 = 0""",
    V.SQL_SIGNALS,
)
def saved_signals(spark, sf):
    """Signals after every second item, and as many unknown ones, got another order and some a verdict."""
    stored = V.signals(spark, sf)
    order = F.struct(*[(F.lit(1) if f.name == "toc" else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.SIGNALS])
    some = stored.where("item_id % 2 = 0").select(*ITEM, order.alias("signals"), F.when(F.col("item_id") % 4 == 0, S.VERDICT_THIN).alias("llm_verdict"))
    out = verify.save_signals(stored, some.union(some.withColumn("item_id", F.lit(-1) - F.col("item_id"))))
    return out.select(*ITEM, "signals.link_src_dst", "signals.toc", "llm_verdict")


@query(
    """, t AS (
  SELECT s.*, concat_ws('；', CASE WHEN is_edge THEN '语料链接: ' || CASE WHEN ahead AND back THEN '互链' WHEN ahead THEN '仅 src→dst' WHEN back THEN '仅 dst→src' ELSE '无互链' END END,
    CASE WHEN refd <> 0 THEN 'RefD 先修信号: ' || CASE WHEN refd > 0 THEN '支持' ELSE '方向可疑' END END, CASE WHEN toc <> 0 THEN '教材目录序: ' || CASE WHEN toc > 0 THEN '支持' ELSE '方向可疑' END END, CASE WHEN wikidata THEN 'Wikidata: P279 src→dst' END,
    CASE WHEN NOT is_edge THEN CASE WHEN NOT has_page THEN '无语料页' ELSE '有语料页' || CASE WHEN exact_title THEN '（名字精确命中标题/重定向）' ELSE '' END || CASE WHEN overlap THEN '（与图谱邻居有重叠）' ELSE '（与图谱邻居无重叠，疑似撞名）' END END END,
    'LLM 复核: ' || verdict || '（r）') AS hint FROM s)
SELECT t.item_type, t.item_id, t.hint FROM t LEFT JOIN e ON is_edge AND e.id = t.item_id WHERE NOT is_edge OR (e.src IN (FROM shown) AND e.dst IN (FROM shown))""",
    V.SQL_SIGNALS, SHOWN_SQL,
)
def signal_hints(spark, sf):
    """The line of signals that a person sees beside each item to review."""
    return verify.triaged(V.nodes(spark, sf), V.edges(spark, sf), V.signals(spark, sf)).select(*ITEM, "hint")
