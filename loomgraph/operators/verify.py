"""Structural signals, review queues and rule-based adjudication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import rules as R
from ..functions import text as X
from ..functions.text import name_in_text
from . import graph, mining, parts
from .docs import toc_vote
from .names import node_names, with_names


def _targets(nodes: DataFrame, pages: DataFrame, mapped: DataFrame) -> DataFrame:
    """(node_id, targets): lower-case names of a node and titles of its page."""
    own = node_names(nodes).select("node_id", F.lower("name").alias("t"))
    titles = mapped.join(pages, ["lang", "page_id"]).select("node_id", F.explode(F.concat(F.array("title"), F.coalesce("redirects", F.array().cast("array<string>")))).alias("t")).select("node_id", F.lower("t").alias("t"))
    return own.union(titles).groupBy("node_id").agg(F.collect_set("t").alias("targets"))


def edge_signals(nodes: DataFrame, edges: DataFrame, pages: DataFrame, mapped: DataFrame, positions: DataFrame, qids: DataFrame, claims: DataFrame) -> DataFrame:
    """Signals of proposed edges: (item_type, item_id, signals); an absent signal is null.

    Only needed pages and names meet: everything is joined by the ends of
    proposed edges.
    """
    e = edges.where("status = 'proposed'").select("id", "src", "dst", "type")
    links = mapped.join(pages, ["lang", "page_id"]).select("node_id", F.transform("links", F.lower).alias("links"))
    targets = _targets(nodes, pages, mapped)
    for way in ("src", "dst"):
        e = e.join(links.select(F.col("node_id").alias(way), F.col("links").alias(f"{way}_links")), way, "left").join(targets.select(F.col("node_id").alias(way), F.col("targets").alias(f"{way}_names")), way, "left")
        e = e.join(qids.select(F.col("node_id").alias(way), F.col("qid").alias("qid_a" if way == "src" else "qid_b")), way, "left")
    both = F.col("src_links").isNotNull() & F.col("dst_links").isNotNull()
    e = e.withColumn("ahead", F.when(both, F.arrays_overlap("src_links", "dst_names"))).withColumn("back", F.when(both, F.arrays_overlap("dst_links", "src_names")))
    e = toc_vote(mining.relation_between(e, claims), positions)
    teaches = F.col("type") == "prerequisite_of"
    told = F.array_join(F.transform("relations", lambda r: F.replace(F.replace(r, F.lit("a→b"), F.lit("src→dst")), F.lit("b→a"), F.lit("dst→src"))), "，")
    values = {"link_src_dst": F.col("ahead"), "link_dst_src": F.col("back"), "refd": F.when(teaches & both, R.reference_direction(F.col("ahead"), F.col("back"))), "toc": F.when(teaches, F.col("toc")), "wikidata": told}
    out = e.select(F.lit("edge").alias("item_type"), F.col("id").alias("item_id"), _signals(values).alias("signals"))
    some = F.coalesce(*[F.col(f"signals.{name}").cast("string") for name in values])
    return out.where(some.isNotNull())


def _signals(values: Mapping[str, Column]) -> Column:
    return F.struct(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.SIGNALS])


def neighbor_overlap(nodes: DataFrame, edges: DataFrame, pages: DataFrame, mapped: DataFrame) -> DataFrame:
    """(node_id, overlap) of proposed nodes with a page: whether it links to or mentions a neighbour's name."""
    e = edges.where("status <> 'rejected' AND src <> dst")
    sides = e.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).union(e.select("dst", "src")).distinct()
    names = node_names(nodes.where("status <> 'rejected'")).where(F.length("name") >= S.MIN_NAME).select(F.col("node_id").alias("other"), "name")
    proposed = nodes.where("status = 'proposed'").select(F.col("id").alias("node_id")).join(mapped, "node_id").join(pages, ["lang", "page_id"]).select("node_id", "text", F.transform("links", F.lower).alias("links"))
    hit = F.array_contains("links", F.lower("name")) | name_in_text(F.col("name"), F.col("text"), 0)
    rows = proposed.join(sides, "node_id").join(names, "other").groupBy("node_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("overlap"))
    return proposed.select("node_id").join(rows, "node_id", "left").select("node_id", F.coalesce("overlap", F.lit(False)).alias("overlap"))


def node_signals(nodes: DataFrame, edges: DataFrame, pages: DataFrame, mapped: DataFrame) -> DataFrame:
    """Signals of proposed nodes: has_page, and with a page exact_title and neighbor_overlap."""
    proposed = nodes.where("status = 'proposed'")
    titled = mapped.join(pages, ["lang", "page_id"]).select("node_id", F.transform(F.concat(F.array("title"), F.coalesce("redirects", F.array().cast("array<string>"))), F.lower).alias("titles"))
    rows = proposed.select(F.col("id").alias("node_id"), F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower).alias("names"))
    rows = rows.join(titled, "node_id", "left").join(neighbor_overlap(nodes, edges, pages, mapped), "node_id", "left")
    values = {"has_page": F.col("titles").isNotNull(), "exact_title": F.arrays_overlap("names", "titles"), "neighbor_overlap": F.col("overlap")}
    return rows.select(F.lit("node").alias("item_type"), F.col("node_id").alias("item_id"), _signals(values).alias("signals"))


def save_signals(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Merges (item_type, item_id, signals[, llm_verdict, llm_reason]) into stored signals, field by field."""
    keys = ["item_type", "item_id"]
    extra = [c for c in ("llm_verdict", "llm_reason") if c in new.columns]
    fresh = new.select(*keys, F.col("signals").alias("_s"), *[F.col(c).alias(f"_{c}") for c in extra])
    both = stored.join(fresh, keys, "full_outer").withColumn("signals", R.merged_signals(F.col("signals"), F.col("_s")))
    return both.withColumns({c: F.coalesce(f"_{c}", c) for c in extra}).select(*stored.columns)


def review_queue(nodes: DataFrame, edges: DataFrame, signals: DataFrame, redo: bool = False) -> DataFrame:
    """Proposed nodes, then proposed edges between visible nodes, that lack a verdict: (item_type, item_id), in that order."""
    shown = nodes.where(S.visible(F.col("status"))).select("id")
    e = edges.where("status = 'proposed'").join(shown.withColumnRenamed("id", "src"), "src", "left_semi").join(shown.withColumnRenamed("id", "dst"), "dst", "left_semi")
    items = nodes.where("status = 'proposed'").select(F.lit("node").alias("item_type"), F.col("id").alias("item_id")).union(e.select(F.lit("edge"), "id"))
    if not redo:
        items = items.join(signals.where(F.coalesce("llm_verdict", F.lit("")) != ""), ["item_type", "item_id"], "left_anti")
    return items.orderBy(F.desc("item_type"), "item_id")


def triaged(nodes: DataFrame, edges: DataFrame, signals: DataFrame) -> DataFrame:
    """What a person has to review, most contested first: (item_type, item_id, tier, label, hint)."""
    queue = review_queue(nodes, edges, signals, redo=True)
    types = edges.select(F.lit("edge").alias("item_type"), F.col("id").alias("item_id"), F.col("type").alias("edge_type"))
    rows = queue.join(types, ["item_type", "item_id"], "left").join(signals, ["item_type", "item_id"], "left")
    told = R.triage(F.col("item_type"), F.col("edge_type"), F.col("signals"), F.col("llm_verdict"))
    hint = R.signal_line(F.col("item_type"), F.col("signals"), F.col("llm_verdict"), F.col("llm_reason"))
    return rows.select("item_type", "item_id", told.alias("t"), hint.alias("hint")).select("item_type", "item_id", "t.*", "hint").orderBy(F.desc("item_type"), "tier", "item_id")


def tier_summary(rows: DataFrame) -> DataFrame:
    """(item_type, tier, n) of triaged items."""
    return rows.groupBy("item_type", "tier").agg(F.count("*").alias("n"))


def related_edges(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, edge_id): proposed edges at the given nodes (id) whose ends are both visible, or among the given nodes."""
    shown = nodes.where(S.visible(F.col("status"))).select("id").union(ids.select("id")).distinct()
    e = edges.where("status = 'proposed'").join(shown.withColumnRenamed("id", "src"), "src", "left_semi").join(shown.withColumnRenamed("id", "dst"), "dst", "left_semi")
    sides = e.select(F.col("id").alias("edge_id"), F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"))
    return sides.join(ids.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").select("node_id", "edge_id")


def auto_nodes(nodes: DataFrame, signals: DataFrame, tiers: Mapping[str, str] | None = None) -> DataFrame:
    """(id, decision) of proposed nodes that the rules settle: approve, or hold where the page may be another concept's."""
    s = signals.where("item_type = 'node'").select(F.col("item_id").alias("id"), "signals", "llm_verdict")
    rows = nodes.where("status = 'proposed'").join(s, "id").where((F.col("llm_verdict") == S.VERDICT_CONCEPT) & R.auto_adjudicable(F.col("source"), tiers))
    rows = rows.where(F.coalesce("signals.has_page", F.lit(False)) & F.coalesce("signals.exact_title", F.lit(False)))
    return rows.select("id", F.when(F.coalesce("signals.neighbor_overlap", F.lit(False)), "approve").otherwise("hold").alias("decision"))


def eligible_edges(nodes: DataFrame, edges: DataFrame, signals: DataFrame, approved: DataFrame, tiers: Mapping[str, str] | None = None) -> DataFrame:
    """(id, src, dst, type, decision): proposed edges between visible or just approved nodes that the rules would approve or reject."""
    shown = nodes.where(S.visible(F.col("status"))).select("id").union(approved.select("id")).distinct()
    s = signals.where("item_type = 'edge' AND coalesce(llm_verdict, '') <> ''").select(F.col("item_id").alias("id"), "signals", "llm_verdict")
    rows = edges.where("status = 'proposed'").join(s, "id").where(R.auto_adjudicable(F.col("source"), tiers))
    rows = rows.join(shown.select(F.col("id").alias("src")), "src", "left_semi").join(shown.select(F.col("id").alias("dst")), "dst", "left_semi")
    backed = R.supported(F.col("signals"))
    approve = (F.col("llm_verdict") == S.VERDICT_SUPPORT) & backed & ~R.opposed(F.col("type"), F.col("signals"))
    reject = F.col("llm_verdict").startswith(S.VERDICT_OPPOSE) & ~backed
    return rows.select("id", "src", "dst", "type", F.when(approve, "approve").when(reject, "reject").alias("decision")).where("decision IS NOT NULL")


def without_cycles(eligible: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, decision): approvals in id order, none of which closes a cycle with live edges and earlier approvals; else hold.

    Only edges that lie on a cycle once all are approved can close one.
    Connected parts of those, of up to ``parts.SQUARE`` links, are settled in
    one task each.  In larger parts a round settles a whole prefix of the
    order: all edges up to the first one that would close a cycle with what is
    live and eligible before it, so rounds are as many as edges held there.
    """
    asked = graph.saved(eligible.where((F.col("decision") == "approve") & F.col("type").isin(*S.ACYCLIC_TYPES)).select("type", "src", "dst", "id"), "asked")
    plain = eligible.where((F.col("decision") == "reject") | ~F.col("type").isin(*S.ACYCLIC_TYPES)).select("id", "decision")
    links = graph.live(edges, *S.ACYCLIC_TYPES).select("type", "src", "dst", F.lit(None).cast("long").alias("id")).union(asked)
    small, large = parts.split(graph.cycle_links(links), parts.SQUARE)
    held = parts.settled(small, parts.held, "id long")
    if large is not None:
        large = graph.saved(large, "large")
        for edge_type in S.ACYCLIC_TYPES:
            rows = large.where(F.col("type") == edge_type)
            todo, base = graph.saved(rows.where("id IS NOT NULL").select("id", "src", "dst"), "todo"), rows.where("id IS NULL").select("src", "dst")
            while (bad := first_closing(todo, base)) is not None:
                held = held.union(todo.where(F.col("id") == bad).select("id"))
                todo = graph.saved(todo.where(F.col("id") != bad), "todo")
    held = graph.saved(held, "held")
    settled = asked.join(held.withColumn("decision", F.lit("hold")), "id", "left").select("id", F.coalesce("decision", F.lit("approve")).alias("decision"))
    return plain.union(settled)


def first_closing(todo: DataFrame, base: DataFrame) -> int | None:
    """The least id of ``todo`` whose edge closes a cycle with ``base`` and smaller ids.

    An edge closes a cycle if a path leads back over base and smaller ids:
    paths are kept with the largest id on them, the least such one for each
    pair of ends.
    """
    links = base.select("src", "dst", F.lit(-1).cast("long").alias("top")).union(todo.select("src", "dst", F.col("id").alias("top")))
    hop = graph.saved(links.groupBy("src", "dst").agg(F.min("top").alias("top")), "hops")
    core = graph._core(hop.select("src", "dst"))
    if core.isEmpty():
        return None
    hop = hop.join(core, ["src", "dst"], "left_semi")
    starts = todo.join(core, ["src", "dst"], "left_semi").select(F.col("dst").alias("src")).distinct()
    best = frontier = graph.saved(starts.select("src", F.col("src").alias("dst"), F.lit(-1).cast("long").alias("top")), "best")
    step = hop.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("top").alias("step_top"))
    while not frontier.isEmpty():
        walked = frontier.join(step, "dst").select("src", F.col("next").alias("dst"), F.greatest("top", "step_top").alias("top")).groupBy("src", "dst").agg(F.min("top").alias("new"))
        frontier = graph.saved(walked.join(best, ["src", "dst"], "left").where("top IS NULL OR new < top").select("src", "dst", F.col("new").alias("top")), "frontier")
        best = graph.saved(best.union(frontier).groupBy("src", "dst").agg(F.min("top").alias("top")), "best")
    back = best.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "top")
    return todo.join(back, ["src", "dst"]).where("top < id").agg(F.min("id")).first()[0]


def apply_auto(nodes: DataFrame, edges: DataFrame, signals: DataFrame, tiers: Mapping[str, str] | None = None) -> DataFrame:
    """All automatic decisions: (item_type, item_id, decision) with approve, reject or hold.

    In shadow mode the same rows are saved as ``auto_would`` and nothing else changes.
    """
    settled = graph.saved(auto_nodes(nodes, signals, tiers), "nodes")
    eligible = graph.saved(eligible_edges(nodes, edges, signals, settled.where("decision = 'approve'"), tiers), "edges")
    return settled.select(F.lit("node").alias("item_type"), F.col("id").alias("item_id"), "decision").union(without_cycles(eligible, edges).select(F.lit("edge"), "id", "decision"))


def review_prompts(queue: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a reviewer is told about each queued item: (item_type, item_id, subject, context)."""
    named = with_names(edges, nodes, src="src_name", dst="dst_name")
    e = named.select(F.lit("edge").alias("item_type"), F.col("id").alias("item_id"), F.format_string("%s -%s-> %s", "src_name", "type", "dst_name").alias("subject"), F.coalesce("rationale", F.lit("")).alias("context"))
    sides = named.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst_name").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src_name").alias("other")))).alias("s")).select("s.*")
    near = sides.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("other")), "、").alias("near"))
    n = nodes.join(near, "id", "left").select(F.lit("node").alias("item_type"), F.col("id").alias("item_id"), F.col("name").alias("subject"), F.concat_ws("\n", F.coalesce("definition", F.lit("")), F.coalesce("near", F.lit("无"))).alias("context"))
    return queue.join(n.union(e), ["item_type", "item_id"])


def source_excerpts(items: DataFrame, pages: DataFrame, sections: DataFrame, around: int = 500) -> DataFrame:
    """Adds ``excerpt`` and ``drifted`` to items (source, evidence): the text around the evidence in what the source names.

    ``drifted`` tells that a section has changed since; a source without a
    stored text has a null excerpt.
    """
    rows = items.withColumns({"_page": X.parse_page_source(F.col("source")), "_sec": X.parse_section_source(F.col("source"))})
    texts = pages.select(F.col("lang").alias("_l"), F.lower("title").alias("_t"), F.col("text").alias("_page_text"))
    rows = rows.join(texts, (F.col("_page.lang") == F.col("_l")) & (F.lower("_page.title") == F.col("_t")), "left")
    bodies = sections.where("coalesce(text, '') <> ''").select(F.col("book").alias("_b"), F.col("sec_id").alias("_s"), F.col("content_hash").alias("_h"), F.col("text").alias("_sec_text"))
    rows = rows.join(bodies, (F.col("_sec.book") == F.col("_b")) & (F.col("_sec.sec_id") == F.col("_s")), "left")
    found = X.excerpt(F.coalesce("_page_text", "_sec_text"), F.col("evidence"), around)
    drifted = F.col("_sec_text").isNotNull() & ~F.col("_h").eqNullSafe(F.col("_sec.hash"))
    return rows.select(*items.columns, found.alias("excerpt"), drifted.alias("drifted"))


def page_heads(nodes: DataFrame, pages: DataFrame, mapped: DataFrame, chars: int = 400) -> DataFrame:
    """(node_id, head): the beginning of each node's page, for items without a quotation."""
    heads = mapped.join(pages, ["lang", "page_id"]).select("node_id", F.substring("text", 1, chars).alias("head"))
    return nodes.select(F.col("id").alias("node_id")).join(heads, "node_id", "left").select("node_id", F.coalesce("head", F.lit("（无语料页）")).alias("head"))
