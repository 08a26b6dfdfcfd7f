"""Knowledge-graph tables derived from the driver's tables, in Spark and as SQL.

Every view covers its whole tables.  Orders are concepts; a customer's
consecutive orders are linked forwards, dear ones also to the one after next,
and cheap ones backwards, so the graph has chains, shortcuts and cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(key: Column, values: dict, other: str | None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(other)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tag = F.col("o_orderkey").cast("string")
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), tag).alias("name"), F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "note").otherwise("concept").alias("type"),
        F.array(F.concat(F.lit("O-"), tag)).alias("aliases"), F.col("o_orderpriority").alias("definition"),
        F.array(F.concat(F.lit("order "), (F.col("o_orderkey") - 1).cast("string")), F.concat(F.lit(S.MISCONCEPTION), tag)).alias("facets"),
        _cases(F.col("o_orderstatus"), {"F": "approved", "O": "seed", "P": "proposed"}, "rejected").alias("status"),
        _cases(F.col("o_orderkey") % 4, {0: "wiki:en:x@1", 1: "doc:book1:2@abcdef012345", 2: "mine:category:en"}, "note").alias("source"), F.col("o_totalprice").alias("created_at"),
    )
    return S.conform(rows, S.NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("*", F.lead("o_orderkey").over(w).alias("n1"), F.lead("o_orderkey", 2).over(w).alias("n2"))
    link = lambda k, src, dst, on: F.when(on & F.col(dst).isNotNull() & F.col(src).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(src).alias("src"), F.col(dst).alias("dst")))
    dear, cheap = F.col("o_totalprice") > 300000, F.col("o_totalprice") < 30000
    links = F.array(link(0, "o_orderkey", "n1", F.lit(True)), link(1, "o_orderkey", "n2", dear), link(2, "n1", "o_orderkey", cheap))
    rows = o.select("*", F.explode(F.filter(links, lambda x: x.isNotNull())).alias("l"))
    kind = _cases(F.col("o_custkey") % 4, {0: "is_a", 1: "part_of", 2: "prerequisite_of"}, "related_to")
    status = F.when((F.col("l.k") == 1) & (F.col("o_orderpriority") == "5-LOW"), "rejected").when(F.col("o_orderkey") % 5 == 0, "proposed").when(F.col("o_orderstatus") == "F", "approved").otherwise("seed")
    rows = rows.select(
        (F.col("o_orderkey") * 4 + F.col("l.k")).alias("id"), "l.src", "l.dst", kind.alias("type"), (F.col("o_totalprice") / 500000).alias("confidence"), F.lit("").alias("rationale"),
        _cases(F.col("o_orderkey") % 3, {0: "wikidata:P279", 1: "doc:book1:2@abcdef012345"}, "note").alias("source"), status.alias("status"), F.col("o_totalprice").alias("created_at"),
    )
    return S.conform(rows, S.EDGES)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of signals for each proposed node and edge, from the digits of its id."""
    i = F.col("item_id")
    items = nodes(spark, sf_dir).where("status = 'proposed'").select(F.lit("node").alias("item_type"), F.col("id").alias("item_id")).union(edges(spark, sf_dir).where("status = 'proposed'").select(F.lit("edge"), "id"))
    edge = F.col("item_type") == "edge"
    put = lambda name, on, value: F.when(on, value).alias(name)
    s = F.struct(
        put("link_src_dst", edge, i % 3 == 0), put("link_dst_src", edge, i % 5 == 0), put("refd", edge, (i % 3 - 1).cast("int")), put("toc", edge, F.nullif(i % 4, F.lit(0)).cast("int") - 2), put("wikidata", edge & (i % 7 == 0), F.lit("P279 src→dst")),
        put("has_page", ~edge, i % 3 != 0), put("exact_title", ~edge & (i % 3 != 0), i % 5 != 0), put("neighbor_overlap", ~edge & (i % 3 != 0), i % 2 == 0), put("auto_would", i % 6 < 4, F.when(i % 2 == 0, "approve").otherwise("reject")),
    )
    v = F.floor(i / 3) % 4
    verdict = F.when(edge, _cases(v, {0: S.VERDICT_SUPPORT, 1: S.VERDICT_OPPOSE, 2: f"{S.VERDICT_SUPPORT}({S.DOUBTFUL})"}, S.VERDICT_THIN)).otherwise(_cases(v, {0: S.VERDICT_CONCEPT, 1: f"{S.VERDICT_FACET}→x", 2: S.VERDICT_CONCEPT}, None))
    return items.select("item_type", "item_id", s.alias("signals"), verdict.alias("llm_verdict"), F.lit("r").alias("llm_reason"), F.lit(0.0).alias("updated_at"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions; users are items."""
    k = F.get_json_object("props", "$.k").cast("int")
    human = k < 50
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(k % 2 == 0, "edge").otherwise("node").alias("item_type"), (F.col("user_id") * 10 + k % 10).alias("item_id"),
        _cases(F.col("event_type"), {"purchase": "approve", "error": "reject", "view": "merge", "signup": "audit_confirm"}, "audit_reject").alias("action"), F.lit("").alias("detail"),
        _cases(F.floor(k / 2) % 4, {0: "mine:category:zh", 1: "doc:cs229:3@0123456789ab", 2: "wiki:zh:x@7"}, "wikidata:P279").alias("source"), F.when(human, "human").otherwise("auto").alias("decided_by"),
        F.when(human, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("batch_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("created_at"),
    )
    return rows


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    title = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), "page_id", title.alias("title"), (F.col("page_id") + 1).alias("revision_id"),
        F.regexp_replace(F.regexp_extract(html, r"<article>([\s\S]*)</article>", 1), "<[^>]*>", " ").alias("text"), F.array(F.split_part(title, F.lit(" "), F.lit(1)), F.split_part(title, F.lit(" "), F.lit(2))).alias("redirects"),
        F.array(F.concat(F.lit("cat "), F.substring_index(title, " ", 1))).alias("categories"), F.regexp_extract_all(html, F.lit('<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1)).alias("links"),
    )
    return S.conform(rows, S.CORPUS)


LANGUAGES = ("en", "de", "fr", "es")


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each linked word; its id is its first place."""
    links = pages(spark, sf_dir).select("page_id", F.posexplode("links").alias("pos", "link"))
    rows = links.groupBy(F.lower("link").alias("name")).agg(F.min(F.col("page_id") * 1000 + F.col("pos")).alias("id"))
    rows = rows.withColumns({"type": F.lit("concept"), "aliases": F.array(F.concat("name", F.lit("s"))), "definition": F.lit(""), "facets": F.array().cast("array<string>"), "status": F.lit("seed"), "source": F.lit("seed:x"), "created_at": F.col("id").cast("double")})
    return S.conform(rows, S.NODES)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("book"), F.col("doc_id").cast("int").alias("ord"), key.alias("sec_id"), F.concat(key, F.lit(" Section "), key).alias("title"), F.concat(F.lit("http://x/"), key).alias("url"),
        F.col("lang").alias("orig_lang"), F.col("text").alias("orig_text"), F.when(F.col("lang") == "en", F.col("text")).otherwise("").alias("text"), F.substring(F.sha2("text", 256), 1, 12).alias("content_hash"),
    )
    return S.conform(rows, S.DOC_SECTIONS)


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts named by the first two words of benchmark texts."""
    words = F.split(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(words[0], F.lit(" "), words[1]).alias("name"))
    return S.conform(rows.withColumns({"type": F.lit("concept"), "aliases": F.array().cast("array<string>"), "status": F.lit("seed"), "facets": F.array().cast("array<string>")}), S.NODES)


def claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(node_id, qid) and claims (qid, claims): every tenth order shares its customer's item; claims follow the edges."""
    o = table(spark, sf_dir, "orders")
    qids = o.select(F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("QC"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("Q"), F.col("o_orderkey").cast("string"))).alias("qid"))
    prop = _cases(F.col("id") % 3, {0: "P279", 1: "P361"}, "P737")
    flat = edges(spark, sf_dir).select(F.concat(F.lit("Q"), F.col("src").cast("string")).alias("qid"), prop.alias("prop"), F.concat(F.lit("Q"), F.col("dst").cast("string")).alias("target"))
    by_prop = flat.groupBy("qid", "prop").agg(F.collect_list("target").alias("targets"))
    return qids, by_prop.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("prop", "targets"))).alias("claims"))


# The same views for DuckDB, as common table expressions.
SQL_NODES = """n AS (
  SELECT o_orderkey AS id, 'Order ' || o_orderkey AS name, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'note' ELSE 'concept' END AS type,
    'O-' || o_orderkey AS alias, o_orderpriority AS definition, 'order ' || (o_orderkey - 1) AS facet,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'seed' WHEN 'P' THEN 'proposed' ELSE 'rejected' END AS status,
    CASE o_orderkey % 4 WHEN 0 THEN 'wiki:en:x@1' WHEN 1 THEN 'doc:book1:2@abcdef012345' WHEN 2 THEN 'mine:category:en' ELSE 'note' END AS source, o_totalprice AS created_at
  FROM orders)"""
SQL_EDGES = """o AS (
  SELECT *, lead(o_orderkey) OVER w AS n1, lead(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
l AS (
  SELECT *, 0 AS k, o_orderkey AS src, n1 AS dst FROM o WHERE n1 IS NOT NULL
  UNION ALL SELECT *, 1, o_orderkey, n2 FROM o WHERE n2 IS NOT NULL AND o_totalprice > 300000
  UNION ALL SELECT *, 2, n1, o_orderkey FROM o WHERE n1 IS NOT NULL AND o_totalprice < 30000),
e AS (
  SELECT o_orderkey * 4 + k AS id, src, dst, CASE o_custkey % 4 WHEN 0 THEN 'is_a' WHEN 1 THEN 'part_of' WHEN 2 THEN 'prerequisite_of' ELSE 'related_to' END AS type,
    o_totalprice / 500000 AS confidence, CASE o_orderkey % 3 WHEN 0 THEN 'wikidata:P279' WHEN 1 THEN 'doc:book1:2@abcdef012345' ELSE 'note' END AS source,
    CASE WHEN k = 1 AND o_orderpriority = '5-LOW' THEN 'rejected' WHEN o_orderkey % 5 = 0 THEN 'proposed' WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'seed' END AS status
  FROM l),
live AS (
  SELECT * FROM e WHERE status IN ('seed', 'approved'))"""
SQL_SIGNALS = f"""{SQL_NODES}, {SQL_EDGES},
i AS (
  SELECT 'node' AS item_type, id AS item_id FROM n WHERE status = 'proposed' UNION ALL SELECT 'edge', id FROM e WHERE status = 'proposed'),
s AS (
  SELECT item_type, item_id, item_type = 'edge' AS is_edge,
    CASE WHEN item_type = 'edge' THEN item_id % 3 = 0 END AS ahead, CASE WHEN item_type = 'edge' THEN item_id % 5 = 0 END AS back, CASE WHEN item_type = 'edge' THEN item_id % 3 - 1 END AS refd,
    CASE WHEN item_type = 'edge' THEN nullif(item_id % 4, 0) - 2 END AS toc, item_type = 'edge' AND item_id % 7 = 0 AS wikidata,
    CASE WHEN item_type = 'node' THEN item_id % 3 <> 0 END AS has_page, item_type = 'node' AND item_id % 3 <> 0 AND item_id % 5 <> 0 AS exact_title,
    CASE WHEN item_type = 'node' AND item_id % 3 <> 0 THEN item_id % 2 = 0 END AS overlap, CASE WHEN item_id % 6 < 4 THEN CASE WHEN item_id % 2 = 0 THEN 'approve' ELSE 'reject' END END AS would,
    CASE WHEN item_type = 'edge' THEN CASE (item_id // 3) % 4 WHEN 0 THEN '支持' WHEN 1 THEN '不支持' WHEN 2 THEN '支持(方向存疑)' ELSE '证据不足' END
      ELSE CASE (item_id // 3) % 4 WHEN 0 THEN '独立概念' WHEN 1 THEN '应为facet→x' WHEN 2 THEN '独立概念' END END AS verdict
  FROM i)"""
SQL_LOG = """g AS (
  SELECT event_id AS id, CASE WHEN k % 2 = 0 THEN 'edge' ELSE 'node' END AS item_type, user_id * 10 + k % 10 AS item_id,
    CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'merge' WHEN 'signup' THEN 'audit_confirm' ELSE 'audit_reject' END AS action,
    CASE (k // 2) % 4 WHEN 0 THEN 'mine:category:zh' WHEN 1 THEN 'doc:cs229:3@0123456789ab' WHEN 2 THEN 'wiki:zh:x@7' ELSE 'wikidata:P279' END AS source,
    CASE WHEN k < 50 THEN 'human' ELSE 'auto' END AS decided_by, CASE WHEN k < 50 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS batch_id, epoch_us(ts)::DOUBLE AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
ch AS (
  SELECT *, CASE source WHEN 'mine:category:zh' THEN 'mine:category' WHEN 'doc:cs229:3@0123456789ab' THEN 'doc:cs229' WHEN 'wiki:zh:x@7' THEN 'ingest/expand' ELSE 'wikidata' END AS channel FROM g),
first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decided_by, item_type, item_id ORDER BY created_at, id) AS nth FROM ch) WHERE nth = 1)"""
SQL_PAGES = r"""p AS (
  SELECT *, split_part(title, ' ', 1) AS redirect, split_part(title, ' ', 2) AS redirect2 FROM (
    SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id + 1 AS revision_id,
      regexp_replace(regexp_extract(html, '<article>([\s\S]*)</article>', 1), '<[^>]*>', ' ', 'g') AS text, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS links
    FROM pages)),
k AS (
  SELECT page_id, lang, title, 0 AS pos, lower(title) AS key FROM p UNION ALL SELECT page_id, lang, title, 1, lower(redirect) FROM p UNION ALL SELECT page_id, lang, title, 2, lower(redirect2) FROM p),
t AS (
  SELECT key, lang, title, page_id FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END DESC, page_id DESC, pos DESC) AS nth
    FROM k WHERE lang IN ('en', 'de', 'fr', 'es')) WHERE nth = 1),
c AS (
  SELECT lang, lower(link) AS title, count(*) AS n FROM (SELECT page_id, lang, unnest(list_distinct(links)) AS link FROM p) GROUP BY ALL),
w AS (
  SELECT lower(link) AS name, min(page_id * 1000 + pos) AS id FROM (SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS pos FROM p) GROUP BY 1),
m AS (
  SELECT w.id AS node_id, coalesce(a.lang, b.lang) AS lang, coalesce(a.page_id, b.page_id) AS page_id
  FROM w LEFT JOIN t a ON a.key = trim(w.name) LEFT JOIN t b ON b.key = trim(w.name || 's') WHERE a.key IS NOT NULL OR b.key IS NOT NULL)"""
SQL_TERMS = """x AS (
  SELECT item_id AS node_id, split_part(c, ' ', 1) || ' ' || split_part(c, ' ', 2) AS name FROM (SELECT item_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS c FROM benchmark)),
h AS (
  SELECT x.node_id, d.source AS book, min(d.doc_id) AS ord
  FROM x JOIN documents d ON length(x.name) >= 3 AND regexp_matches(lower(d.text), '(^|[^\\pL\\pN_])' || lower(x.name) || '([^\\pL\\pN_]|$)') GROUP BY ALL)""".replace("\\\\", "\\")
