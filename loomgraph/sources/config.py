"""Book configurations and seed graphs in YAML."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.names import name_index, resolve

REQUIRED = ("book", "title", "lang", "type", "sections")


def _yaml(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:  # an optional library
        raise RuntimeError("reading YAML needs the yaml library") from e
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def check_book(cfg: dict) -> dict:
    """The configuration itself, or ValueError with what is wrong in it."""
    missing = [k for k in REQUIRED if not cfg.get(k)]
    rules = [
        (not missing, f"missing: {', '.join(missing)}"),
        (re.fullmatch(r"[a-z0-9-]+", str(cfg.get("book"))), f"book must be of a-z, 0-9 and -: {cfg.get('book')}"),
        (cfg.get("type") in ("html", "pdf"), f"type must be html or pdf: {cfg.get('type')}"),
        (cfg.get("tier") in (None, "", *S.TIERS), f"tier must be one of {S.TIERS}: {cfg.get('tier')}"),
        (cfg.get("type") != "pdf" or cfg.get("pdf_url"), "a pdf book needs pdf_url"),
        (all(len(s) == 4 for s in cfg.get("sections") or ()), "a section is [ord, sec_id, title, locator]"),
    ]
    for fine, what in rules:
        if not fine:
            raise ValueError(what)
    return cfg


def load_book(path: str) -> dict:
    return check_book(_yaml(path))


def book_sections(spark: SparkSession, cfg: dict) -> DataFrame:
    """(book, ord, sec_id, title, url, orig_lang) of a configuration."""
    rows = [(cfg["book"], int(o), str(i), str(t), str(u), cfg["lang"]) for o, i, t, u in cfg["sections"]]
    return spark.createDataFrame(rows, "book string, ord int, sec_id string, title string, url string, orig_lang string")


def book_tiers(configs: list[dict]) -> dict[str, str]:
    return {c["book"]: c.get("tier") or "high" for c in configs}


def load_seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return seed_graph(spark, _yaml(path))


def seed_graph(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and skipped edges of a seed graph.

    Edge ends are names or aliases.  A node whose name is taken by an earlier
    one is left out; equal edges count once; an edge with an unknown end is
    skipped, and so is a related_to edge whose reverse came before.
    """
    source, taken, rows = data.get("source", "seed"), set(), []
    for spec in data.get("nodes", []):
        name = spec["name"].strip()
        if name.lower() in taken:
            continue
        aliases = list(spec.get("aliases", []))
        taken |= {name.lower(), *(a.lower() for a in aliases)}
        rows.append((len(rows) + 1, name, "concept", aliases, (spec.get("definition") or "").strip(), list(spec.get("facets", [])), "seed", source, None, 0.0))
    nodes = spark.createDataFrame(rows, S.NODES)
    given = [(i, str(s[0]), s[1], str(s[2]), float(s[3]) if len(s) > 3 else 1.0) for i, s in enumerate(data.get("edges", []))]
    index = name_index(nodes)
    edges = resolve(resolve(spark.createDataFrame(given, "pos long, a string, type string, b string, confidence double"), "a", index, "src"), "b", index, "dst")
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    turned = (F.col("type") == "related_to") & (F.col("src") > F.col("dst"))
    key = F.when(turned, F.struct(F.col("dst").alias("x"), F.col("src").alias("y"))).otherwise(F.struct(F.col("src").alias("x"), F.col("dst").alias("y")))
    first = known.groupBy(key.alias("key"), "type").agg(F.min(F.struct("pos", "src", "dst", "confidence")).alias("e"))
    out = first.select((F.col("e.pos") + 1).alias("id"), "e.src", "e.dst", "type", "e.confidence", F.lit("").alias("rationale"), F.lit(source).alias("source"), F.lit("seed").alias("status"), F.lit(0.0).alias("created_at"))
    return nodes, S.conform(out, S.EDGES), edges.where("src IS NULL OR dst IS NULL").select("pos", "a", "type", "b")
