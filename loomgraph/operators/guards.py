"""Consistency guards: each gives the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import graph
from .names import node_names, with_names


def mutual_edges(edges: DataFrame) -> DataFrame:
    """(type, src, dst) of live edges whose reverse of the same type is live too, each pair once."""
    a, b = graph.live(edges).alias("a"), graph.live(edges).alias("b")
    same = (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, same).select("a.type", "a.src", "a.dst")


def bad_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, not rejected, with an end that is missing or of a type that the edge type doesn't allow."""
    allowed = F.create_map(*[x for t, (src, dst) in S.ENDPOINTS.items() for x in (F.lit(t), F.struct(F.array(*map(F.lit, src)).alias("src"), F.array(*map(F.lit, dst)).alias("dst")))])
    ends = lambda way: nodes.select(F.col("id").alias(way), F.col("type").alias(f"{way}_type"))
    e = edges.where("status <> 'rejected'").join(ends("src"), "src", "left").join(ends("dst"), "dst", "left")
    fits = lambda way: F.coalesce(F.array_contains(allowed[F.col("type")][way], F.col(f"{way}_type")), F.lit(False))
    return e.where(~(fits("src") & fits("dst"))).select("id", "type", "src", "src_type", "dst", "dst_type")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Visible nodes without a live edge."""
    e = graph.live(edges)
    ends = e.select(F.col("src").alias("id")).union(e.select("dst"))
    return nodes.where(S.visible(F.col("status"))).join(ends, "id", "left_anti").select("id", "name")


def facet_shadows(nodes: DataFrame) -> DataFrame:
    """(id, name, facet, target): facets that are another node's name or alias."""
    known = nodes.where("status <> 'rejected'")
    # The last node by id, and in it the last of name and aliases, owns a name.
    owner = node_names(known).join(known.select(F.col("id").alias("node_id"), F.col("name").alias("target")), "node_id")
    owner = owner.groupBy(F.lower("name").alias("key")).agg(F.max_by("target", F.struct("node_id", "pos")).alias("target"))
    facets = known.select("id", "name", F.explode("facets").alias("facet"))
    return facets.join(owner, F.lower("facet") == F.col("key")).where("target <> name").select("id", "name", "facet", "target")


def all_guards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All violations as (guard, detail)."""
    pair = lambda df, guard, arrow: with_names(df, nodes, src="_a", dst="_b").select(F.lit(guard).alias("guard"), F.concat_ws(arrow, "_a", "_b").alias("detail"))
    parts = [pair(graph.cycle_edges(edges, t), f"cycle:{t}", " -> ") for t in S.ACYCLIC_TYPES]
    parts.append(pair(graph.redundant(graph.live(edges, "prerequisite_of")), "redundant_prerequisite", " -> "))
    mutual = with_names(mutual_edges(edges), nodes, src="_a", dst="_b")
    parts.append(mutual.select(F.lit("mutual").alias("guard"), F.format_string("%s <-%s-> %s", "_a", "type", "_b").alias("detail")))
    bad = with_names(bad_endpoints(nodes, edges), nodes, src="_a", dst="_b")
    end = lambda name, way: F.concat(F.coalesce(name, F.concat(F.lit("#"), F.col(way).cast("string"))), F.lit("("), F.coalesce(f"{way}_type", F.lit("?")), F.lit(")"))
    parts.append(bad.select(F.lit("endpoint").alias("guard"), F.concat(end(F.col("_a"), "src"), F.lit(" -"), "type", F.lit("-> "), end(F.col("_b"), "dst")).alias("detail")))
    parts.append(orphans(nodes, edges).select(F.lit("orphan").alias("guard"), F.col("name").alias("detail")))
    parts.append(facet_shadows(nodes).select(F.lit("facet_shadow").alias("guard"), F.format_string("%s: %s = %s", "name", "facet", "target").alias("detail")))
    return reduce(DataFrame.unionByName, parts)
