"""Candidate aliases and edges from page structure and external claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import strip
from .names import name_index, node_names, resolve, with_names

# Properties, the edge type each gives, and its wording; the classes among them.
PROPERTIES = {"P279": ("is_a", "{a} 是 {b} 的子类"), "P361": ("part_of", "{a} 是 {b} 的一部分"), "P737": ("related_to", "{a} 受 {b} 影响")}
SPINE = ("P279", "P361")
INSPIRED = "P737"


def alias_claims(nodes: DataFrame, pages: DataFrame, mapped: DataFrame) -> DataFrame:
    """(node_id, pos, alias, owner): each redirect of a node's page that isn't yet a name of the node.

    ``owner`` is another node's name if it holds the alias already, or if an
    earlier node claims it in this run; null means that the alias is new.
    """
    known = nodes.where("status <> 'rejected'")
    named = node_names(known).select("node_id", "pos", F.lower("name").alias("key"))
    # Names beat aliases, the last node's name and the first node's alias win.
    names = named.where("pos = 0").groupBy("key").agg(F.max("node_id").alias("by_name"))
    aliases = named.where("pos > 0").groupBy("key").agg(F.min("node_id").alias("by_alias"))
    owner = names.join(aliases, "key", "full_outer").select("key", F.coalesce("by_name", "by_alias").alias("owner_id"))
    redirects = mapped.join(known.select(F.col("id").alias("node_id")), "node_id", "left_semi").join(pages, ["lang", "page_id"]).select("node_id", F.posexplode("redirects").alias("pos", "r"))
    rows = redirects.select("node_id", "pos", strip(F.col("r")).alias("alias")).where((F.col("alias") != "") & (F.length("alias") <= S.MAX_ALIAS)).withColumn("key", F.lower("alias"))
    rows = rows.join(named.select("node_id", "key"), ["node_id", "key"], "left_anti").join(owner, "key", "left")
    first = Window.partitionBy("key").orderBy("node_id", "pos")
    rows = rows.withColumn("claimed", F.first("node_id").over(first)).withColumn("nth", F.row_number().over(Window.partitionBy("node_id", "key").orderBy("pos")))
    taken = F.when(F.col("owner_id") != F.col("node_id"), F.col("owner_id")).when(F.col("claimed") != F.col("node_id"), F.col("claimed"))
    return with_names(rows.where("nth = 1").withColumn("taken", taken), nodes, taken="owner").select("node_id", "pos", "alias", "owner")


def with_aliases(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """Nodes with their unclaimed new aliases appended in page order."""
    new = claims.where("owner IS NULL").groupBy(F.col("node_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias"))), lambda x: x["alias"]).alias("new"))
    return nodes.join(new, "id", "left").withColumn("aliases", F.concat("aliases", F.coalesce("new", F.array().cast("array<string>")))).select(*nodes.columns)


def category_edges(nodes: DataFrame, pages: DataFrame, mapped: DataFrame) -> DataFrame:
    """part_of candidates from a node's page categories that name another node."""
    known = nodes.where("status <> 'rejected'").select(F.col("id").alias("node_id"))
    rows = mapped.join(known, "node_id", "left_semi").join(pages, ["lang", "page_id"]).select("node_id", "lang", "title", F.explode("categories").alias("category"))
    rows = resolve(rows, "category", name_index(nodes), "target").where("target IS NOT NULL AND target <> node_id")
    rationale = F.concat(F.lit("[分类挖掘] 页面《"), "title", F.lit("》属于维基分类「"), "category", F.lit("」"))
    return candidate(rows.select(F.col("node_id").alias("src"), F.col("target").alias("dst"), F.lit("part_of").alias("type"), F.lit(S.CATEGORY_CONFIDENCE).alias("confidence"), rationale.alias("rationale"), F.concat(F.lit("mine:category:"), "lang").alias("source")))


def candidate(edges: DataFrame) -> DataFrame:
    """One proposed edge for each (src, dst, type)."""
    return edges.groupBy("src", "dst", "type").agg(F.min_by(F.struct("confidence", "rationale", "source"), "rationale").alias("e")).select("src", "dst", "type", "e.*", F.lit("proposed").alias("status"))


def new_edges(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates that aren't stored yet; a related_to edge counts as stored if its reverse is and isn't rejected.

    Of two candidates that are each other's reverse, the one with the smaller
    source is taken.
    """
    stored = edges.select("src", "dst", "type")
    reverse = edges.where("type = 'related_to' AND status <> 'rejected'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    fresh = candidates.join(stored.union(reverse), ["src", "dst", "type"], "left_anti")
    twin = F.when(F.col("type") == "related_to", F.least("src", "dst")).otherwise(F.col("src"))
    other = F.when(F.col("type") == "related_to", F.greatest("src", "dst")).otherwise(F.col("dst"))
    w = Window.partitionBy("type", twin, other).orderBy("src")
    return fresh.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def missing_qids(node_page: DataFrame, page_qid: DataFrame) -> DataFrame:
    """Mapped pages whose item was never looked up."""
    return node_page.join(page_qid, ["lang", "page_id"], "left_anti").select("lang", "page_id").distinct()


def missing_claims(page_qid: DataFrame, claims: DataFrame) -> DataFrame:
    """Items whose claims were never fetched; an empty item means there is none."""
    return page_qid.where("qid <> ''").join(claims, "qid", "left_anti").select("qid").distinct()


def node_qids(nodes: DataFrame, node_page: DataFrame, page_qid: DataFrame) -> DataFrame:
    rows = nodes.where("status <> 'rejected'").select(F.col("id").alias("node_id")).join(node_page, "node_id").join(page_qid, ["lang", "page_id"])
    return rows.where("qid <> ''").select("node_id", "qid")


def shared_qids(qids: DataFrame) -> DataFrame:
    """(qid, nodes): items that several nodes share; such nodes take no part in mining."""
    return qids.groupBy("qid").agg(F.array_sort(F.collect_list("node_id")).alias("nodes")).where(F.size("nodes") > 1)


def own_qids(qids: DataFrame) -> DataFrame:
    return qids.groupBy("qid").agg(F.min("node_id").alias("node_id"), F.count("*").alias("n")).where("n = 1").select("qid", "node_id")


def flat_claims(claims: DataFrame) -> DataFrame:
    """(qid, prop, target) of all claims."""
    return claims.select("qid", F.explode("claims").alias("prop", "targets")).select("qid", "prop", F.explode("targets").alias("target"))


def relation_between(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds ``relations`` to pairs (qid_a, qid_b): claims between them, by property, a→b first."""
    flat = flat_claims(claims).where(F.col("prop").isin(*PROPERTIES)).distinct()
    ends = pairs.select("qid_a", "qid_b").distinct()
    ahead = ends.join(flat, (F.col("qid") == F.col("qid_a")) & (F.col("target") == F.col("qid_b"))).select("qid_a", "qid_b", "prop", F.lit(0).alias("way"))
    back = ends.join(flat, (F.col("qid") == F.col("qid_b")) & (F.col("target") == F.col("qid_a"))).select("qid_a", "qid_b", "prop", F.lit(1).alias("way"))
    found = ahead.union(back).groupBy("qid_a", "qid_b").agg(F.array_sort(F.collect_list(F.struct("prop", "way"))).alias("r"))
    text = F.transform("r", lambda x: F.concat(x["prop"], F.when(x["way"] == 0, " a→b").otherwise(" b→a")))
    return pairs.join(found.select("qid_a", "qid_b", text.alias("relations")), ["qid_a", "qid_b"], "left")


def claim_edges(nodes: DataFrame, qids: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidate edges from claims between items that one node each has; inspiration points from the inspiring node."""
    own = own_qids(qids)
    rows = flat_claims(claims).where(F.col("prop").isin(*PROPERTIES)).join(own.withColumnRenamed("node_id", "a"), "qid")
    rows = rows.join(own.select(F.col("qid").alias("target"), F.col("node_id").alias("b")), "target").where("a <> b")
    rows = with_names(rows, nodes, a="a_name", b="b_name")
    pick = lambda i: F.create_map(*[F.lit(x) for p, v in PROPERTIES.items() for x in (p, v[i])])[F.col("prop")]
    said = F.replace(F.replace(pick(1), F.lit("{a}"), F.col("a_name")), F.lit("{b}"), F.col("b_name"))
    turned = F.col("prop") == INSPIRED
    rationale = F.concat(F.when(turned, "[演化启发] ").otherwise(""), F.lit("[Wikidata] "), said, F.lit("（"), "prop", F.lit("）"))
    src, dst = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    return candidate(rows.select(src.alias("src"), dst.alias("dst"), pick(0).alias("type"), F.lit(S.MINED_CONFIDENCE).alias("confidence"), rationale.alias("rationale"), F.concat(F.lit("wikidata:"), "prop").alias("source")))


def spine_targets(nodes: DataFrame, qids: DataFrame, claims: DataFrame) -> DataFrame:
    """(qid, child_id): classes that a node's item belongs to and no node has yet, with the first node that asks for each."""
    own = own_qids(qids)
    rows = flat_claims(claims).where(F.col("prop").isin(*SPINE)).join(own, "qid")
    return rows.join(own.select(F.col("qid").alias("target")), "target", "left_anti").groupBy(F.col("target").alias("qid")).agg(F.min("node_id").alias("child_id"))


def spine_nodes(targets: DataFrame, sitelinks: DataFrame, pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, child_id, title, label, node_id): classes with a usable page; node_id is the node to reuse, null for a new one.

    ``sitelinks`` is (qid, lang, title, label).
    """
    rows = targets.join(sitelinks, "qid").join(pages.select("lang", F.col("title").alias("page_title"), "page_id"), (F.lower("title") == F.lower("page_title")) & (sitelinks["lang"] == pages["lang"])).drop(pages["lang"])
    index = name_index(nodes)
    rows = resolve(resolve(rows, "page_title", index, "by_title"), "label", index, "by_label")
    return rows.select("qid", "child_id", F.col("page_title").alias("title"), "label", F.coalesce("by_title", "by_label").alias("node_id"))
