"""The daily run: named steps in order, each failure recorded and the rest still run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..operators import corpus, ingest, mining, names, verify
from ..operators.docs import concept_positions
from ..operators.graph import saved
from ..sources.catalog import Catalog


@dataclass
class Step:
    name: str
    seconds: float
    error: str | None


def run_steps(steps: list[tuple[str, Callable[[], object]]]) -> list[Step]:
    done = []
    for name, work in steps:
        began, error = time.time(), None
        try:
            work()
        except Exception as e:  # later steps don't depend on this one's success
            error = f"{type(e).__name__}: {e}"
        done.append(Step(name, time.time() - began, error))
    return done


def mapped_pages(c: Catalog):
    return names.page_for_node(c.read("nodes"), names.title_index(c.read("corpus")), c.read("node_page"), c.read("corpus"))


def map_nodes(c: Catalog) -> None:
    c.replace("node_page", mapped_pages(c))


def mine_aliases(c: Catalog) -> None:
    nodes = c.read("nodes")
    c.replace("nodes", mining.with_aliases(nodes, mining.alias_claims(nodes, c.read("corpus"), mapped_pages(c))))


def mine_edges(c: Catalog, now: float) -> None:
    nodes, edges = c.read("nodes"), c.read("edges")
    qids = mining.node_qids(nodes, c.read("node_page"), c.read("page_qid"))
    found = mining.category_edges(nodes, c.read("corpus"), mapped_pages(c)).unionByName(mining.claim_edges(nodes, qids, c.read("wikidata_claims")))
    c.replace("edges", ingest.add_edges(edges, nodes, found, now))


def refresh_signals(c: Catalog, now: float) -> None:
    nodes, edges, pages, mapped = c.read("nodes"), c.read("edges"), c.read("corpus"), mapped_pages(c)
    qids = mining.node_qids(nodes, c.read("node_page"), c.read("page_qid"))
    new = verify.edge_signals(nodes, edges, pages, mapped, concept_positions(nodes, c.read("doc_sections")), qids, c.read("wikidata_claims"))
    new = new.unionByName(verify.node_signals(nodes, edges, pages, mapped))
    c.replace("review_signals", verify.save_signals(c.read("review_signals"), new).withColumn("updated_at", F.lit(now)))


def adjudicate(c: Catalog, batch_id: str, now: float, shadow: bool = False, tiers: dict[str, str] | None = None) -> None:
    """Applies automatic decisions, or only records what they would be."""
    from ..operators.decisions import append_log, with_status

    nodes, edges, signals = c.read("nodes"), c.read("edges"), c.read("review_signals")
    settled = saved(verify.apply_auto(nodes, edges, signals, tiers).where("decision <> 'hold'"), "decisions")
    if shadow:
        rows = settled.join(signals.select("item_type", "item_id", "signals"), ["item_type", "item_id"])
        c.replace("review_signals", verify.save_signals(signals, rows.select("item_type", "item_id", F.col("signals").withField("auto_would", F.col("decision")).alias("signals"))))
        return
    sources = nodes.select(F.lit("node").alias("item_type"), F.col("id").alias("item_id"), "source").union(edges.select(F.lit("edge"), "id", "source"))
    entries = settled.join(sources, ["item_type", "item_id"]).join(signals.select("item_type", "item_id", "llm_reason"), ["item_type", "item_id"], "left")
    entries = entries.select("item_type", "item_id", F.col("decision").alias("action"), F.coalesce("llm_reason", F.lit("")).alias("detail"), "source", F.lit("auto").alias("decided_by"), F.lit(batch_id).alias("batch_id"), F.lit(now).alias("created_at"))
    new_nodes, new_edges, new_log = nodes, edges, append_log(c.read("review_log"), entries)
    for status, action in (("approved", "approve"), ("rejected", "reject")):
        hit = settled.where(F.col("decision") == action)
        new_nodes, new_edges = with_status(new_nodes, hit, "node", status), with_status(new_edges, hit, "edge", status)
    for name, rows in (("review_log", saved(new_log, "log")), ("nodes", saved(new_nodes, "nodes")), ("edges", saved(new_edges, "edges"))):
        c.replace(name, rows)


def undo(c: Catalog, batch_id: str, now: float) -> None:
    """Puts a batch's items back to proposed and logs it; the log entry counts as a human decision."""
    from ..operators.decisions import append_log, rollback, with_status

    nodes, edges, log = c.read("nodes"), c.read("edges"), c.read("review_log")
    back = saved(rollback(nodes, edges, log, batch_id).where("outcome <> 'skipped'"), "rollback")
    entries = back.select("item_type", "item_id", F.lit("rollback").alias("action"), F.concat(F.lit(f"batch {batch_id}: "), "outcome").alias("detail"), F.lit("").alias("source"), F.lit("human").alias("decided_by"), F.lit(batch_id).alias("batch_id"), F.lit(now).alias("created_at"))
    parts = {"review_log": append_log(log, entries), "nodes": with_status(nodes, back, "node", "proposed"), "edges": with_status(edges, back, "edge", "proposed")}
    for name, rows in [(k, saved(v, k)) for k, v in parts.items()]:
        c.replace(name, rows)


def daily(c: Catalog, batch_id: str, shadow: bool = False) -> list[Step]:
    """Mapping, mining, signals and adjudication over what the catalog holds."""
    now = time.time()
    return run_steps([
        ("map pages", lambda: map_nodes(c)), ("mine aliases", lambda: mine_aliases(c)), ("mine edges", lambda: mine_edges(c, now)), ("signals", lambda: refresh_signals(c, now)),
        ("adjudicate", lambda: adjudicate(c, batch_id, now, shadow)), ("statistics", lambda: corpus.corpus_stats(c.read("corpus")).collect()),
    ])
