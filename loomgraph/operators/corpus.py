"""Page corpus: storage, statistics, growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import page_source
from ..functions.udfs import similar
from . import graph
from .names import first_per, page_for_node, title_index


def latest_pages(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with ``new`` pages (later id wins) replacing those of the same (lang, page_id) or (lang, title)."""
    rows = stored.unionByName(new)
    by_id = first_per(rows, ["lang", "page_id"], F.desc("id"))
    return first_per(by_id, ["lang", "title"], F.desc("id"))


def disambiguation(pages: DataFrame) -> DataFrame:
    """Adds is_disambiguation: a category has one of the markers."""
    marked = F.exists(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.lower(c).rlike("|".join(S.DISAMBIGUATION)))
    return pages.withColumn("is_disambiguation", marked)


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages long enough to learn from that aren't disambiguations."""
    return disambiguation(pages).where((F.length("text") >= S.MIN_PAGE) & ~F.col("is_disambiguation")).drop("is_disambiguation")


def matching_pages(terms: DataFrame, pages: DataFrame, least: float = S.TITLE_SIMILARITY) -> DataFrame:
    """(term, lang, page_id, score): fetched candidates (term, lang, page_id) whose title or a redirect is like the term."""
    names = usable_pages(pages).select("lang", "page_id", F.explode(F.concat(F.array("title"), F.coalesce("redirects", F.array().cast("array<string>")))).alias("t"))
    scored = terms.join(names, ["lang", "page_id"]).groupBy("term", "lang", "page_id").agg(F.max(similar("term", "t")).alias("score"))
    return scored.where(F.col("score") >= least)


def link_counts(pages: DataFrame) -> DataFrame:
    """(lang, title, n): pages that link to a lower-case title; equal links of one page count once."""
    links = pages.select("lang", F.explode(F.array_distinct("links")).alias("link"))
    return links.groupBy("lang", F.lower("link").alias("title")).agg(F.count("*").alias("n"))


def grow_candidates(pages: DataFrame, limit: int, languages: tuple[str, ...] = ("en", "zh")) -> DataFrame:
    """The ``limit`` most linked titles that no language's index has; ties by language and title."""
    known = title_index(pages, languages).select(F.col("key").alias("title"))
    return link_counts(pages).join(known, "title", "left_anti").orderBy(F.desc("n"), "lang", "title").limit(limit)


def crawl_queue(nodes: DataFrame, mapped: DataFrame, limit: int | None = None) -> DataFrame:
    """Visible nodes without a page, in id order: (id, name, aliases)."""
    todo = nodes.where(S.visible(F.col("status"))).join(mapped.select(F.col("node_id").alias("id")), "id", "left_anti").select("id", "name", "aliases").orderBy("id")
    return todo if limit is None else todo.limit(limit)


def corpus_stats(pages: DataFrame) -> DataFrame:
    """(lang, pages, links, redirects) by language."""
    size = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0))).cast("long")
    return pages.groupBy("lang").agg(F.count("*").alias("pages"), size("links").alias("links"), size("redirects").alias("redirects"))


def coverage(nodes: DataFrame, pages: DataFrame, languages: tuple[str, ...] = ("en", "zh")) -> DataFrame:
    """(covered, total) over visible nodes."""
    shown = nodes.where(S.visible(F.col("status")))
    found = page_for_node(shown, title_index(pages, languages))
    return shown.join(found, shown["id"] == found["node_id"], "left").agg(F.count("node_id").alias("covered"), F.count("*").alias("total"))


def anchor_queue(nodes: DataFrame, edges: DataFrame, pages: DataFrame, ingest_log: DataFrame, k: int, mapped: DataFrame) -> DataFrame:
    """The k visible nodes with most links to their page per edge in the graph: (node_id, name, score, indegree).

    Pages already read in this revision are skipped.  Equal titles among the
    title and redirects of a page count each time.  Ties go to the smaller id.
    """
    counts = link_counts(pages)
    names = pages.select("lang", "page_id", F.explode(F.concat(F.array("title"), F.coalesce("redirects", F.array().cast("array<string>")))).alias("t"))
    indegree = names.join(counts, (names["lang"] == counts["lang"]) & (F.lower("t") == counts["title"])).groupBy(names["lang"], "page_id").agg(F.sum("n").alias("indegree"))
    rows = nodes.where(S.visible(F.col("status"))).select(F.col("id").alias("node_id"), "name").join(mapped, "node_id")
    rows = rows.join(pages.select("lang", "page_id", page_source(F.col("lang"), F.col("title"), F.col("revision_id")).alias("source")), ["lang", "page_id"])
    rows = rows.join(ingest_log.select(F.col("anchor").alias("name"), "source"), ["name", "source"], "left_anti")
    rows = rows.join(indegree, ["lang", "page_id"], "left").join(graph.degree(edges), "node_id", "left")
    score = F.coalesce("indegree", F.lit(0)) / (1 + F.coalesce("degree", F.lit(0)))
    return rows.select("node_id", "name", score.alias("score"), F.coalesce("indegree", F.lit(0)).alias("indegree")).orderBy(F.desc("score"), "node_id").limit(k)


def frontier(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k visible nodes with the fewest edges, newest first."""
    rows = nodes.where(S.visible(F.col("status"))).join(graph.degree(edges), F.col("id") == F.col("node_id"), "left")
    return rows.select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree"), "created_at").orderBy("degree", F.desc("created_at"), "id").limit(k)
