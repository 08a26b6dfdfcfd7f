"""Command line: python -m loomgraph --root DIR COMMAND ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calibrate, corpus, docs, export, guards, names, verify
from .plans import batch
from .sources import catalog, config


def show(df: DataFrame, n: int = 200) -> None:
    df.show(n, truncate=False)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    c = catalog.Catalog(spark, args.root)
    nodes, edges, log = c.read("nodes"), c.read("edges"), c.read("review_log")
    if args.command == "seed":
        n, e, skipped = config.load_seed(spark, args.path)
        c.replace("nodes", n)
        c.replace("edges", e)
        show(skipped)
    elif args.command == "stats":
        for df in (nodes.groupBy("status").count(), edges.groupBy("status").count(), edges.groupBy("type").count(), calibrate.log_counts(log), corpus.corpus_stats(c.read("corpus")), docs.doc_stats(c.read("doc_sections"))):
            show(df)
    elif args.command == "check":
        show(guards.all_guards(nodes, edges))
    elif args.command == "calibrate":
        items = nodes.select(F.lit("node").alias("item_type"), F.col("id").alias("item_id"), "source").union(edges.select(F.lit("edge"), "id", "source"))
        for df in (calibrate.human_precision(log, edges, c.read("review_signals")), calibrate.auto_overturn(log), calibrate.shadow_agreement(log, c.read("review_signals"), items)):
            show(df)
    elif args.command == "viz":
        print(export.write_html(nodes, edges, args.path))
    elif args.command == "export":
        who = catalog.named(nodes, args.name).select("id")
        reading = export.resources(nodes, c.read("doc_sections"), c.read("corpus"), names.page_for_node(nodes, names.title_index(c.read("corpus")), c.read("node_page")))
        for line in export.neighborhood(nodes, edges, who, reading).toJSON().collect():
            print(line)
    elif args.command == "docs-add":
        c.replace("doc_sections", docs.register(c.read("doc_sections"), config.book_sections(spark, config.load_book(args.path))))
    elif args.command == "anchors":
        mapped = names.page_for_node(nodes, names.title_index(c.read("corpus")), c.read("node_page"))
        show(corpus.anchor_queue(nodes, edges, c.read("corpus"), c.read("ingest_log"), args.k, mapped))
        show(docs.anchor_queue(nodes, edges, c.read("doc_sections"), c.read("ingest_log"), args.k))
    elif args.command == "mine":
        batch.mine_aliases(c)
        batch.mine_edges(c, time.time())
    elif args.command == "verify":
        batch.refresh_signals(c, time.time())
        if args.apply:
            batch.adjudicate(c, time.strftime("auto-%Y%m%d-%H%M%S"), time.time(), args.dry_run)
    elif args.command == "review":
        show(verify.triaged(nodes, edges, c.read("review_signals")))
    elif args.command == "rollback":
        show(calibrate.batches(log)) if args.batch is None else batch.undo(c, args.batch, time.time())
    elif args.command == "daily":
        for step in batch.daily(c, time.strftime("auto-%Y%m%d-%H%M%S"), args.dry_run):
            print(step)
    elif args.command == "frontier":
        show(corpus.frontier(nodes, edges, args.k))
    elif args.command == "missing":
        show(corpus.crawl_queue(nodes, c.read("node_page")))


def main() -> None:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--root", required=True, help="folder of tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("stats", "check", "calibrate", "mine", "review", "missing"):
        sub.add_parser(name)
    for name in ("seed", "viz", "docs-add"):
        sub.add_parser(name).add_argument("path")
    sub.add_parser("export").add_argument("name")
    for name in ("anchors", "frontier"):
        sub.add_parser(name).add_argument("-k", type=int, default=3)
    v = sub.add_parser("verify")
    v.add_argument("--apply", action="store_true")
    v.add_argument("--dry-run", action="store_true")
    sub.add_parser("daily").add_argument("--dry-run", action="store_true")
    sub.add_parser("rollback").add_argument("batch", nargs="?")
    args = p.parse_args()
    run(SparkSession.builder.appName("loomgraph").getOrCreate(), args)


if __name__ == "__main__":
    main()
