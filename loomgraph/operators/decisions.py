"""Review decisions as pure transforms of nodes, edges and log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import graph
from .dedup import append_missing
from .names import name_index, resolve


def rollback(nodes: DataFrame, edges: DataFrame, log: DataFrame, batch_id: str) -> DataFrame:
    """(item_type, item_id, outcome): what undoing an automatic batch does.

    ``reverted`` items go back to proposed; ``skipped`` ones were decided again
    later; ``cascaded`` edges are approved and end at a reverted node.
    """
    last = log.groupBy("item_type", "item_id").agg(F.max("id").alias("last"))
    rows = log.where((F.col("batch_id") == batch_id) & (F.col("decided_by") == "auto") & F.col("action").isin("approve", "reject")).join(last, ["item_type", "item_id"])
    own = rows.groupBy("item_type", "item_id").agg(F.when(F.max("id") == F.max("last"), "reverted").otherwise("skipped").alias("outcome"))
    back = own.where("item_type = 'node' AND outcome = 'reverted'").select(F.col("item_id").alias("node_id"))
    approved = edges.where("status = 'approved'")
    hit = approved.join(back, F.col("src") == F.col("node_id"), "left_semi").select("id").union(approved.join(back, F.col("dst") == F.col("node_id"), "left_semi").select("id")).distinct()
    cascade = hit.select(F.lit("edge").alias("item_type"), F.col("id").alias("item_id")).join(own.where("outcome = 'reverted'"), ["item_type", "item_id"], "left_anti")
    return own.union(cascade.withColumn("outcome", F.lit("cascaded")))


def with_status(rows: DataFrame, changes: DataFrame, item_type: str, status: str) -> DataFrame:
    """Rows of the given items (item_type, item_id) set to a status."""
    new = changes.where(F.col("item_type") == item_type).select(F.col("item_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    return rows.join(new, "id", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).select(*rows.columns)


def later_decision(log: DataFrame) -> DataFrame:
    """Log rows with whether the same item was decided again later."""
    w = Window.partitionBy("item_type", "item_id")
    return log.withColumn("has_later", F.max("id").over(w) > F.col("id"))


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """Log with new rows (item_type, item_id, action, detail, source, decided_by, batch_id, created_at) under the next ids, in item order."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = graph.numbered(new, top, "item_type", "item_id", "decided_by", "action", "detail", "created_at")
    return log.unionByName(numbered.select(*log.columns))


def decide_nodes(nodes: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after decisions (id, action, target) on nodes.

    approve and reject set the status; merge makes the name an alias of the
    target and moves the edges there; demote makes it a facet.  Rejected and
    demoted nodes take their proposed edges with them.  Decisions whose target
    is missing or the node itself are left out.
    """
    asked = resolve(decisions, "target", name_index(nodes), "target_id")
    moves = F.col("action").isin("merge", "demote")
    valid = asked.where(~moves | (F.col("target_id").isNotNull() & (F.col("target_id") != F.col("id")))).select("id", "action", "target_id")
    named = valid.join(nodes.select("id", "name"), "id")
    given = named.where(moves).groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_set(F.when(F.col("action") == "merge", F.col("name")))).alias("_a"), F.array_sort(F.collect_set(F.when(F.col("action") == "demote", F.col("name")))).alias("_f"))
    out = nodes.join(valid.select("id", F.col("action").alias("_action")), "id", "left").join(given, "id", "left")
    out = out.withColumns({
        "status": F.when(F.col("_action") == "approve", "approved").when(F.col("_action").isNotNull(), "rejected").otherwise(F.col("status")),
        "aliases": append_missing(F.col("aliases"), F.filter("_a", lambda a: F.lower(a) != F.lower(F.col("name")))), "facets": append_missing(F.col("facets"), F.col("_f")),
    }).select(*nodes.columns)
    moved = valid.where("action = 'merge'")
    e = edges
    for end in ("src", "dst"):
        e = e.join(moved.select(F.col("id").alias(end), F.col("target_id").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    gone = valid.where(F.col("action").isin("reject", "demote")).select("id")
    lost = e.where("status = 'proposed'").select("id", F.explode(F.array("src", "dst")).alias("end")).join(gone.withColumnRenamed("id", "end"), "end", "left_semi").select("id").distinct()
    e = e.join(lost.withColumn("_lost", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_lost"), "rejected").otherwise(F.col("status"))).select(*edges.columns)
    return out, e


def decide_edges(edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges after decisions (id, action, new_type, kind), and what happened (id, outcome, detail).

    flip turns an edge round and retype gives it another type; both approve it
    unless such an edge exists, which rejects it.  A retype to an unknown or
    the same type, or to related_to without an allowed kind, is left out.
    """
    rows = edges.join(decisions.select("id", "action", "new_type", "kind"), "id")
    fine = F.col("new_type").isin(*S.EDGE_TYPES) & (F.col("new_type") != F.col("type")) & ((F.col("new_type") != "related_to") | F.col("kind").isin(*S.RELATED_KINDS))
    rows = rows.where((F.col("action") != "retype") | F.coalesce(fine, F.lit(False)))
    flip, retype = F.col("action") == "flip", F.col("action") == "retype"
    rows = rows.withColumns({"to_src": F.when(flip, F.col("dst")).otherwise(F.col("src")), "to_dst": F.when(flip, F.col("src")).otherwise(F.col("dst")), "to_type": F.when(retype, F.col("new_type")).otherwise(F.col("type"))})
    taken = edges.select(F.col("src").alias("to_src"), F.col("dst").alias("to_dst"), F.col("type").alias("to_type"), F.col("id").alias("other"))
    clash = rows.where(flip | retype).select("id", "to_src", "to_dst", "to_type").join(taken, ["to_src", "to_dst", "to_type"])
    clash = clash.join(rows.select("id", "action"), "id").where((F.col("action") == "flip") | (F.col("other") != F.col("id"))).groupBy("id").agg(F.min("other").alias("clash"))
    rows = rows.join(clash, "id", "left")
    changed = (flip | retype) & F.col("clash").isNull()
    tag = F.when(flip, F.concat(F.lit("[人工翻转] "), "rationale")).when(retype, F.concat(F.lit("[人工改型 "), "type", F.lit("->"), "new_type", F.lit("] "), F.when(F.col("new_type") == "related_to", F.concat(F.lit("["), "kind", F.lit("] "))).otherwise(""), "rationale"))
    status = F.when(F.col("action") == "approve", "approved").when((F.col("action") == "reject") | F.col("clash").isNotNull(), "rejected").otherwise("approved")
    new = rows.select("id", F.when(changed, F.col("to_src")).otherwise(F.col("src")).alias("_src"), F.when(changed, F.col("to_dst")).otherwise(F.col("dst")).alias("_dst"), F.when(changed, F.col("to_type")).otherwise(F.col("type")).alias("_type"), F.when(changed, tag).otherwise(F.col("rationale")).alias("_rationale"), status.alias("_status"))
    out = edges.join(new, "id", "left")
    for c in ("src", "dst", "type", "rationale", "status"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    outcome = F.when(F.col("clash").isNotNull(), "reject").otherwise(F.col("action"))
    detail = F.when(F.col("clash").isNotNull(), F.concat(F.lit("id="), F.col("clash").cast("string"))).when(retype, F.concat_ws("->", "type", "new_type")).otherwise("")
    return out.select(*edges.columns), rows.select("id", outcome.alias("outcome"), detail.alias("detail"))


def audited(nodes: DataFrame, edges: DataFrame, audits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after audits (item_type, item_id, action): audit_reject rejects the item."""
    bad = audits.where("action = 'audit_reject'")
    return with_status(nodes, bad, "node", "rejected"), with_status(edges, bad, "edge", "rejected")
