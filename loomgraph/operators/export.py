"""Neighbourhoods, reading lists and graph exports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from . import docs, graph
from .names import with_names


def split_facets(nodes: DataFrame) -> DataFrame:
    """Nodes with facets and misconceptions apart, the latter without their prefix."""
    wrong = lambda f: f.startswith(S.MISCONCEPTION)
    return nodes.withColumn("misconceptions", F.transform(F.filter("facets", wrong), lambda f: F.substring(f, len(S.MISCONCEPTION) + 1, 1 << 30))).withColumn("facets", F.filter("facets", lambda f: ~wrong(f)))


def resources(nodes: DataFrame, sections: DataFrame, pages: DataFrame, mapped: DataFrame) -> DataFrame:
    """(node_id, rank, kind, book, title, url): where to read about each node; section titles, then its page, then mentions."""
    hits = docs.concept_positions(nodes, sections).join(docs.bodies(sections).select("book", "ord", "sec_id", "title", "url"), ["book", "ord"])
    told = hits.select("node_id", F.when(F.col("how") == "title", 0).otherwise(2).alias("rank"), F.lit("doc").alias("kind"), "book", "title", X.section_url(F.col("url"), F.col("book"), F.col("sec_id")).alias("url"))
    wiki = mapped.join(pages, ["lang", "page_id"]).select("node_id", F.lit(1).alias("rank"), F.lit("wiki").alias("kind"), F.lit(None).cast("string").alias("book"), "title", X.page_url(F.col("lang"), F.col("title")).alias("url"))
    return told.union(wiki)


def neighborhood(nodes: DataFrame, edges: DataFrame, ids: DataFrame, reading: DataFrame | None = None) -> DataFrame:
    """One record for each node of ``ids`` (id): definition, facets, prerequisites, what it unlocks, taxonomy, reading.

    All asked nodes are answered by the same joins; chains come from one
    closure that starts at them.  Lists are ordered by edge, depth or rank.
    """
    base = split_facets(nodes).join(ids.select("id").distinct(), "id").select("id", "name", "aliases", "definition", "facets", "misconceptions")
    live = with_names(graph.live(edges), nodes, src="src_name", dst="dst_name")
    teaches = live.where("type = 'prerequisite_of'")
    ordered = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("v")))), lambda x: x["v"])
    direct = teaches.groupBy(F.col("dst").alias("id")).agg(ordered(F.col("id"), "src_name").alias("direct_prerequisites"))
    unlocks = teaches.groupBy(F.col("src").alias("id")).agg(ordered(F.col("id"), "dst_name").alias("unlocks"))
    chain = with_names(graph.ancestors(edges, ids.select(F.col("id").alias("src"))), nodes, ancestor_id="a_name")
    chain = chain.groupBy(F.col("node_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor_id", "a_name"))), lambda x: x["a_name"]).alias("prerequisite_chain"))
    kinds = live.where("type IN ('is_a', 'part_of')").withColumn("line", F.format_string("%s -%s-> %s", "src_name", "type", "dst_name"))
    kinds = kinds.select("id", "line", F.explode(F.array_distinct(F.array("src", "dst"))).alias("end")).groupBy(F.col("end").alias("id")).agg(ordered(F.col("id"), "line").alias("taxonomy"))
    for part in (direct, chain, unlocks, kinds):
        base = base.join(part, "id", "left")
    if reading is not None:
        listed = reading.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "book", "kind", "title", "url"))).alias("resources"))
        base = base.join(listed, "id", "left")
    return base


def one_hop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, line): live edges around each node, written out."""
    rows = with_names(graph.live(edges), nodes, src="src_name", dst="dst_name").withColumn("line", F.format_string("%s -%s-> %s", "src_name", "type", "dst_name"))
    return rows.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"), "line")


def shown_graph(nodes: DataFrame, edges: DataFrame, proposed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Visible (and proposed) nodes, and such edges between them."""
    wanted = S.VISIBLE + (("proposed",) if proposed else ())
    n = nodes.where(F.col("status").isin(*wanted)).select("id", "name", "aliases", "definition", "facets", "status", "source")
    e = edges.where(F.col("status").isin(*wanted)).join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
    return n, e.select("src", "dst", "type", "status")


PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>knowledge graph</title></head>
<body><input id="find" placeholder="name"><div id="out"></div><script>
const graph = __DATA__;
const byId = new Map(graph.nodes.map(n => [n.id, n]));
const degree = new Map();
for (const l of graph.links) for (const end of new Set([l.src, l.dst])) degree.set(end, (degree.get(end) || 0) + 1);
const out = document.getElementById("out");
function show(word) {
  out.replaceChildren();
  const hits = graph.nodes.filter(n => n.name.includes(word)).sort((a, b) => (degree.get(b.id) || 0) - (degree.get(a.id) || 0));
  for (const n of hits) {
    const box = document.createElement("details"), head = document.createElement("summary");
    head.textContent = `${n.name} [${n.status}] (${degree.get(n.id) || 0})`;
    box.append(head, n.definition || "");
    for (const l of graph.links.filter(l => l.src === n.id || l.dst === n.id)) {
      const line = document.createElement("div");
      line.textContent = `${byId.get(l.src).name} -${l.type}-> ${byId.get(l.dst).name}`;
      box.append(line);
    }
    out.append(box);
  }
}
document.getElementById("find").oninput = e => show(e.target.value);
show("");
</script></body></html>
"""


def write_html(nodes: DataFrame, edges: DataFrame, path: str, proposed: bool = True, most: int = 50_000) -> str:
    """A page to browse the graph; refuses graphs that a browser couldn't hold."""
    n, e = shown_graph(nodes, edges, proposed)
    if n.count() > most or e.count() > most:
        raise ValueError(f"more than {most} nodes or edges; filter first")
    data = {"nodes": [json.loads(x) for x in n.toJSON().collect()], "links": [json.loads(x) for x in e.toJSON().collect()]}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(PAGE.replace("__DATA__", json.dumps(data, ensure_ascii=False).replace("</", "<\\/")), encoding="utf-8")
    return path
