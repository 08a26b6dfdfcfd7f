"""Graph operators over edges (src, dst, type, status)."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import parts
from .work import saved, work_path  # noqa: F401


def live(edges: DataFrame, *types: str) -> DataFrame:
    out = edges.where(S.visible(F.col("status")))
    return out.where(F.col("type").isin(*types)) if types else out


def numbered(rows: DataFrame, top: int, *order: str, column: str = "id") -> DataFrame:
    """``rows`` with ids from ``top`` + 1 in the order of some columns, which tell rows apart.

    Rows are dealt out by ranges of that order and numbered range by range; the
    driver sees a count for each range, so no task holds more than one.
    """
    dealt = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts, start, starts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}, top, {}
    for part in sorted(counts):
        starts[part], start = start, start + counts[part]
    if not starts:
        return dealt.withColumn(column, F.lit(top).cast("long")).drop("_part")
    first = F.create_map(*[F.lit(x) for item in starts.items() for x in item])[F.col("_part")]
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn(column, (nth + first).cast("long")).drop("_part")


def degree(edges: DataFrame) -> DataFrame:
    """(node_id, degree): live edges at each node; a loop counts once."""
    ends = live(edges).select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def _links(links: DataFrame) -> DataFrame:
    """(type, src, dst) of links of one type."""
    return links.select(F.lit("").alias("type"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def closure(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): nodes that a path of 1 or more links reaches, with the shortest depth.

    Connected parts of up to ``parts.SQUARE`` links are walked whole in one
    task each, larger ones a link further each round.  ``start`` (src) limits
    the sources, so that one question doesn't compute all pairs.
    """
    rows = _links(links)
    if start is None:
        rows = rows.withColumn("asked", F.lit(True))
    else:
        rows = rows.join(start.select(F.col("src").cast("long").alias("src"), F.lit(True).alias("asked")).distinct(), "src", "left").select("type", "src", "dst", F.coalesce("asked", F.lit(False)).alias("asked"))
    small, large = parts.split(rows, parts.SQUARE)
    out = parts.settled(small, parts.reached, "src long, dst long, depth int")
    return out if large is None else out.union(_walked(large, large.where("asked").select("src")))


def _walked(links: DataFrame, start: DataFrame) -> DataFrame:
    """``closure`` by rounds: a frontier goes one link further each time and drops pairs already reached, so cycles end."""
    step = saved(links.select("src", "dst").distinct(), "links")
    reached = step.join(start.distinct(), "src", "left_semi").select("src", "dst")
    reached = frontier = saved(reached.withColumn("depth", F.lit(1)), "reached")
    hop = step.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for depth in itertools.count(2):
        new = frontier.join(hop, "dst").select("src", F.col("next").alias("dst")).distinct().join(reached, ["src", "dst"], "left_anti")
        frontier = saved(new.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def ancestors(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node_id, ancestor_id, depth): everything that must be known before a node; the node itself is left out."""
    back = live(edges, "prerequisite_of").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(back, start).where("src <> dst").select(F.col("src").alias("node_id"), F.col("dst").alias("ancestor_id"), "depth")


def _core(links: DataFrame) -> DataFrame:
    """Links left after nodes without way in or way out are taken off again and again: non-empty iff there is a cycle."""
    core = saved(links.select("src", "dst").distinct(), "core")
    n = core.count()
    while n:
        core = saved(core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "core")
        n, before = core.count(), n
        if n == before:
            break
    return core


def cycle_links(links: DataFrame) -> DataFrame:
    """``links`` (type, src, dst, ...) that lie on a cycle of their type.

    Connected parts of up to ``parts.LINEAR`` links are settled in one task
    each.  In larger ones nodes off every cycle go first, so the closure is
    taken of the core only.
    """
    small, large = parts.split(links, parts.LINEAR)
    out = parts.settled(small, parts.cycle_links, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema)).select(*links.columns)
    if large is None:
        return out
    for kind in sorted(r["type"] for r in large.select("type").distinct().collect()):
        rows = large.where(F.col("type") == kind)
        core = _core(rows)
        back = _walked(core, core.select("src")).select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        out = out.union(rows.join(core.join(back, ["src", "dst"], "left_semi"), ["src", "dst"], "left_semi").select(*links.columns))
    return out


def cycle_edges(edges: DataFrame, *types: str) -> DataFrame:
    """(type, src, dst): live edges of some types that lie on a cycle; a canonical form of all their cycles."""
    return cycle_links(live(edges, *types).select("type", "src", "dst")).distinct()


def cycle_nodes(edges: DataFrame, edge_type: str) -> DataFrame:
    return cycle_edges(edges, edge_type).select(F.col("src").alias("node_id")).distinct()


def redundant(links: DataFrame) -> DataFrame:
    """(src, dst): direct links that a path through other nodes makes needless.

    The path leaves src by another link and meets neither src nor dst on its
    way; loops are left to the cycle guard.  Connected parts of up to
    ``parts.SQUARE`` links are settled whole in one task each.  In larger ones
    all (src, at) pairs are walked first; where dst lies on no cycle, arriving
    there by another link is proof, and the few other pairs are walked again
    with dst closed.
    """
    small, large = parts.split(_links(links).where("src <> dst"), parts.SQUARE)
    out = parts.settled(small, parts.needless, "src long, dst long")
    if large is None:
        return out
    step = saved(large.select("src", "dst").distinct(), "links")
    hop = step.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    start = step.select("src", F.col("dst").alias("at"))
    likely = _arrivals(start, hop, step, ["src"])
    turning = _core(step).select("dst").distinct()
    doubtful = likely.join(turning, "dst", "left_semi")
    again = doubtful.select("src", "dst").join(start, "src").where("at <> dst").select("src", "dst", "at")
    return out.union(likely.join(turning, "dst", "left_anti").select("src", "dst")).union(_arrivals(again, hop, doubtful, ["src", "dst"]))


def _arrivals(start: DataFrame, hop: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of ``wanted`` that walks from ``start`` (keys, at) arrive at, two links or more from src."""
    reached = frontier = saved(start.select(*keys, "at").distinct(), "paths")
    found = []
    while not frontier.isEmpty():
        walked = frontier.join(hop, "at").where("next <> src")
        ends = walked.where("next = dst") if "dst" in keys else walked.withColumn("dst", F.col("next"))
        found.append(saved(ends.select("src", "dst").distinct().join(wanted, ["src", "dst"], "left_semi"), "arrivals"))
        on = walked.where("next <> dst") if "dst" in keys else walked
        frontier = saved(on.select(*keys, F.col("next").alias("at")).distinct().join(reached, [*keys, "at"], "left_anti"), "paths")
        reached = reached.union(frontier)
    return reduce(DataFrame.union, found).distinct() if found else wanted.select("src", "dst").limit(0)


def around(edges: DataFrame) -> DataFrame:
    """(node_id, edge_id, type, other_id, way): live edges seen from both ends; a loop once."""
    e = live(edges)
    out = e.select(F.col("src").alias("node_id"), F.col("id").alias("edge_id"), "type", F.col("dst").alias("other_id"), F.lit("out").alias("way"))
    return out.union(e.where("src <> dst").select("dst", "id", "type", "src", F.lit("in")))


def would_cycle(edge: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of ``edge`` (id, src, dst) whose source is reachable from their target by ``links``, or is it."""
    reach = closure(links, edge.select(F.col("dst").alias("src"))).select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return edge.where("src = dst").union(edge.where("src <> dst").join(reach, ["src", "dst"], "left_semi").select(*edge.columns))
