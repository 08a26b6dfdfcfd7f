"""From model answers to evidenced nodes, edges, facets and misconceptions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..functions.udfs import PICKED_BLOCKS, split_blocks
from . import graph
from .dedup import append_missing
from .names import first_per, name_index, resolve
from .work import small_batches

#: Schema of an extraction answer.
ANSWER = (
    "struct<concepts:array<struct<name:string,aliases:array<string>,definition:string,facets:array<string>,evidence:string,"
    "edges:array<struct<other:string,type:string,kind:string,inferred:string,direction:string,confidence:double,evidence:string>>>>,"
    "anchor_facets:array<string>,misconceptions:array<struct<concept:string,text:string,evidence:string>>>"
)


def picked_blocks(pages: DataFrame, names: Column, most: int = PICKED_BLOCKS) -> DataFrame:
    """Pages (columns kept, text replaced) as blocks: adds pos, n_blocks and block.

    The first block stays, others by how often they hold one of ``names``, up
    to ``most``, in text order.  Equal rows are pages of their own.
    """
    small_batches(pages.sparkSession)
    rows = pages.withColumn("_names", F.transform(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), X.norm)).withColumn("_id", F.monotonically_increasing_id())
    cut = rows.withColumn("_blocks", split_blocks("text"))
    cut = cut.select(*[c for c in cut.columns if c not in ("_blocks", "text")], F.posexplode("_blocks").alias("pos", "block"))
    score = F.aggregate("_names", F.lit(0), lambda s, n: s + X.occurrences(X.norm(F.col("block")), n))
    order = Window.partitionBy("_id").orderBy(F.desc(F.col("pos") == 0), F.desc("_score"), "pos")
    ranked = cut.withColumn("_score", score).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most)
    return ranked.withColumn("n_blocks", F.count("*").over(Window.partitionBy("_id"))).drop("_names", "_id", "_score", "_nth")


def quota(cap: int, n_blocks: int) -> int:
    """Concepts that each block may bring so that a page stays near ``cap``."""
    return max(1, math.ceil(cap / n_blocks))


def parsed(answers: DataFrame) -> DataFrame:
    """Answers (source, pos, answer) with ``a``, the extraction in them; broken ones are null."""
    return answers.withColumn("a", F.from_json("answer", ANSWER))


def concepts(answers: DataFrame, cap: int) -> DataFrame:
    """(source, nth, name, ...): the first ``cap`` different concepts of a page, by block and place."""
    rows = answers.select("source", "pos", F.posexplode("a.concepts").alias("at", "c")).select("source", "pos", "at", X.strip(F.col("c.name")).alias("name"), F.col("c.definition").alias("definition"), F.col("c.aliases").alias("aliases"), F.col("c.facets").alias("facets"), F.col("c.evidence").alias("evidence"), F.col("c.edges").alias("edges"))
    rows = first_per(rows.where("coalesce(name, '') <> ''").withColumn("key", F.lower("name")), ["source", "key"], F.col("pos"), F.col("at"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("pos", "at"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= cap).drop("pos", "at", "key")


def evidenced(rows: DataFrame, texts: DataFrame, requotes: DataFrame | None = None) -> DataFrame:
    """Adds ``grounded`` to rows (source, evidence): whether the evidence stands in the page (source, text).

    ``requotes`` (source, evidence, requote) are second tries for failed ones;
    a second quotation has to stand in the text as well.
    """
    joined = rows.join(texts.select("source", F.col("text").alias("_text")), "source")
    first = X.evidence_in_text(F.col("evidence"), F.col("_text"))
    if requotes is None:
        return joined.withColumn("grounded", first).drop("_text")
    joined = joined.join(requotes, ["source", "evidence"], "left")
    second = X.evidence_in_text(F.col("requote"), F.col("_text"))
    return joined.withColumn("grounded", first | second).withColumn("evidence", F.when(~first & second, F.col("requote")).otherwise(F.col("evidence"))).drop("_text", "requote")


def edge_candidates(found: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Proposed edges of grounded concepts (source, name, node_id, edges), with why others are dropped in ``dropped``."""
    rows = found.select("source", F.col("node_id").alias("new_id"), F.explode("edges").alias("e")).select("source", "new_id", "e.*")
    rows = resolve(rows, "other", name_index(nodes), "known_id")
    own = found.select(F.col("source"), F.col("name").alias("_name"), F.col("node_id").alias("_own"))
    rows = rows.join(own.withColumnRenamed("source", "_s"), (F.col("_s") == F.col("source")) & (X.strip(F.col("other")) == F.col("_name")), "left").withColumn("other_id", F.coalesce("known_id", "_own"))
    rows = evidenced(rows.select("source", "new_id", "other_id", "type", "kind", "inferred", "direction", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("evidence", F.lit("")).alias("evidence")), texts)
    admissible = F.coalesce(F.col("other_id").isNotNull() & (F.col("other_id") != F.col("new_id")) & F.col("type").isin(*S.EDGE_TYPES), F.lit(False))
    related = F.col("type") == "related_to"
    dropped = F.when(~admissible, "endpoint").when(~F.col("grounded"), "evidence").when(related & ~F.coalesce(F.col("kind").isin(*S.RELATED_KINDS), F.lit(False)), "kind")
    guess = (F.col("type") == "prerequisite_of") & (F.coalesce("inferred", F.lit("")) == "true")
    turned = F.col("direction") == "other_to_new"
    rationale = F.concat(F.when(related, F.concat(F.lit("["), F.coalesce("kind", F.lit("")), F.lit("] "))).when(guess, "[推断] ").otherwise(""), "evidence")
    return rows.select(
        F.when(turned, F.col("other_id")).otherwise(F.col("new_id")).alias("src"), F.when(turned, F.col("new_id")).otherwise(F.col("other_id")).alias("dst"), "type",
        F.when(guess, F.least("confidence", F.lit(S.INFERRED_CONFIDENCE))).otherwise(F.col("confidence")).alias("confidence"), rationale.alias("rationale"), "source", F.lit("proposed").alias("status"), dropped.alias("dropped"),
    )


def with_anchor_facets(nodes: DataFrame, answers: DataFrame, anchors: DataFrame) -> DataFrame:
    """Nodes with short facets that answers give for their page's anchor (source, node_id), in order."""
    rows = answers.join(anchors, "source").select(F.col("node_id").alias("id"), "pos", F.posexplode("a.anchor_facets").alias("at", "f")).where((F.col("f") != "") & (F.length("f") <= S.MAX_FACET))
    new = rows.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", "f"))), lambda x: x["f"])).alias("_f"))
    return nodes.join(new, "id", "left").withColumn("facets", append_missing(F.col("facets"), F.col("_f"))).select(*nodes.columns)


def with_misconceptions(nodes: DataFrame, answers: DataFrame, texts: DataFrame) -> DataFrame:
    """Nodes with grounded misconceptions as prefixed facets; unknown and rejected owners are left out."""
    rows = answers.select("source", "pos", F.posexplode("a.misconceptions").alias("at", "m")).select("source", "pos", "at", X.strip(F.col("m.concept")).alias("concept"), X.strip(F.col("m.text")).alias("said"), F.col("m.evidence").alias("evidence"))
    rows = rows.where((F.coalesce("concept", F.lit("")) != "") & (F.coalesce("said", F.lit("")) != "") & (F.length("said") <= S.MAX_MISCONCEPTION))
    rows = resolve(evidenced(rows, texts).where("grounded"), "concept", name_index(nodes), "node_id").join(nodes.where("status <> 'rejected'").select(F.col("id").alias("node_id")), "node_id", "left_semi")
    new = rows.groupBy(F.col("node_id").alias("id")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("source", "pos", "at", "said"))), lambda x: F.concat(F.lit(S.MISCONCEPTION), x["said"]))).alias("_f"))
    return nodes.join(new, "id", "left").withColumn("facets", append_missing(F.col("facets"), F.col("_f"))).select(*nodes.columns)


def add_nodes(nodes: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """Nodes with new ones (name, definition, aliases, facets, source[, status]) under the next ids; the first of equal names counts and known names are left out."""
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = first_per(new.withColumn("name", X.strip(F.col("name"))), ["name"], F.col("source")).join(nodes.select("name"), "name", "left_anti")
    numbered = graph.numbered(fresh, top, "source", "name").withColumn("type", F.lit("concept")).withColumn("created_at", F.lit(now))
    if "status" not in fresh.columns:
        numbered = numbered.withColumn("status", F.lit("proposed"))
    return nodes.unionByName(numbered.select(*[c for c in nodes.columns if c in numbered.columns]), allowMissingColumns=True)


def add_edges(edges: DataFrame, nodes: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """Edges with new ones (src, dst, type, confidence, rationale, source, status) under the next ids.

    Duplicates, related_to edges whose reverse exists, and edges with a missing
    end or one of a type not allowed are left out.
    """
    from .guards import bad_endpoints
    from .mining import new_edges

    top = edges.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    one = first_per(new, ["src", "dst", "type"], F.desc("confidence"), F.col("source"), F.col("rationale"))
    fresh = new_edges(one, edges)
    numbered = graph.numbered(fresh, top, "src", "dst", "type").withColumn("created_at", F.lit(now))
    numbered = numbered.join(bad_endpoints(nodes, numbered).select("id"), "id", "left_anti")
    return edges.unionByName(numbered.select(*edges.columns))


def log_ingest(log: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """Ingest log with (anchor, source) pairs that it lacks."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = new.select("anchor", "source").distinct().join(log, ["anchor", "source"], "left_anti")
    numbered = graph.numbered(fresh, top, "anchor", "source").withColumn("created_at", F.lit(now))
    return log.unionByName(numbered.select(*log.columns))


def gaps(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, aliases, why) of hypotheses in gap answers (answer) that no node covers yet."""
    rows = answers.select(F.explode(F.from_json("answer", "struct<gaps:array<struct<name:string,aliases:array<string>,why:string>>>")["gaps"]).alias("g")).select(X.strip(F.col("g.name")).alias("name"), "g.aliases", "g.why")
    return resolve(rows.where("coalesce(name, '') <> ''"), "name", name_index(nodes), "known").where("known IS NULL").drop("known")


def ingest_counts(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, what, n): how many concepts and edge candidates of each page were kept or dropped, and why."""
    concepts_ = found.select("source", F.when(F.col("grounded"), "concept kept").otherwise("concept without evidence").alias("what"))
    edges_ = edges.select("source", F.concat(F.lit("edge "), F.coalesce(F.concat(F.lit("without "), "dropped"), F.lit("kept"))).alias("what"))
    return concepts_.union(edges_).groupBy("source", "what").agg(F.count("*").alias("n"))
