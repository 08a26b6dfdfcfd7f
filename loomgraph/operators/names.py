"""Resolving names to nodes and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, node_id): the node that a lower-case name or alias means.

    A name counts for nodes of any status and beats aliases; an alias counts
    for nodes that aren't rejected.  Ties go to the smaller id.
    """
    names = nodes.select(key(F.col("name")).alias("key"), F.col("id").alias("named"), F.lit(None).cast("long").alias("called"))
    aliases = nodes.where("status <> 'rejected'").select(F.explode("aliases").alias("alias"), "id").select(F.lower("alias").alias("key"), F.lit(None).cast("long"), F.col("id"))
    return names.union(aliases).groupBy("key").agg(F.coalesce(F.min("named"), F.min("called")).alias("node_id"))


def resolve(rows: DataFrame, column: str, index: DataFrame, out: str) -> DataFrame:
    """Adds the node that ``column`` names, or null."""
    found = index.select(F.col("key").alias("_key"), F.col("node_id").alias(out))
    return rows.join(found, key(F.col(column)) == F.col("_key"), "left").drop("_key")


def node_names(nodes: DataFrame) -> DataFrame:
    """(node_id, pos, name): the name of each node and its aliases in order."""
    return nodes.select(F.col("id").alias("node_id"), F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "name"))


def title_index(pages: DataFrame, languages: tuple[str, ...] = ("en", "zh")) -> DataFrame:
    """(key, lang, title, page_id): the page of a lower-case title or redirect.

    Later ``languages`` override earlier ones; inside a language the later row
    wins, and inside a page the later redirect.  Pages in other languages are
    left out.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    keys = F.posexplode(F.concat(F.array("title"), F.coalesce("redirects", F.array().cast("array<string>"))))
    rows = pages.where(F.col("lang").isin(*languages)).select(rank.alias("rank"), "id", "lang", "title", "page_id", keys.alias("pos", "name"))
    order = F.struct("rank", "id", "pos")
    return rows.groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct("lang", "title", "page_id"), order).alias("page")).select("key", "page.*")


def page_for_node(nodes: DataFrame, titles: DataFrame, node_page: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(node_id, lang, page_id): the mapped page, else the page of the first name or alias in the title index.

    A mapping to a page that ``pages`` no longer has doesn't count.
    """
    found = node_names(nodes).join(titles, key(F.col("name")) == titles["key"]).groupBy("node_id").agg(F.min_by(F.struct("lang", "page_id"), "pos").alias("page"))
    if node_page is None:
        return found.select("node_id", "page.*")
    told = node_page if pages is None else node_page.join(pages.select("lang", "page_id"), ["lang", "page_id"], "left_semi")
    told = told.select("node_id", F.struct("lang", "page_id").alias("told"))
    return nodes.select(F.col("id").alias("node_id")).join(told, "node_id", "left").join(found, "node_id", "left").select("node_id", F.coalesce("told", "page").alias("page")).where("page IS NOT NULL").select("node_id", "page.*")


def node_for_page(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, lang, node_id): the first node, not rejected, with a name or alias among a page's title and redirects."""
    keys = pages.select("lang", "page_id", F.explode(F.concat(F.array("title"), F.coalesce("redirects", F.array().cast("array<string>")))).alias("t")).select("lang", "page_id", F.lower("t").alias("key")).distinct()
    names = node_names(nodes.where("status <> 'rejected'")).select("node_id", F.lower("name").alias("key"))
    return keys.join(names, "key").groupBy("lang", "page_id").agg(F.min("node_id").alias("node_id"))


def with_names(rows: DataFrame, nodes: DataFrame, **columns: str) -> DataFrame:
    """Adds names of node ids: with_names(df, nodes, src="src_name")."""
    for column, out in columns.items():
        rows = rows.join(nodes.select(F.col("id").alias(f"_{out}"), F.col("name").alias(out)), F.col(column) == F.col(f"_{out}"), "left").drop(f"_{out}")
    return rows


def first_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
