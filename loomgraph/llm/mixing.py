"""Mixing sources to target weights by hash-threshold histograms (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, n_words

#: Hexadecimal digits of the hash that one histogram level resolves.
DIGITS = 3
#: Levels of refinement: 3 x 12 bits of hash decide a document.
LEVELS = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Word budget of every source: (source, source_size, target).

    ``sizes`` has a row for each source (source, source_size).  Sources by code
    point, null last, weigh ``weights`` in turn.  Together they get ``share``
    of all words; none gets over ``most`` times its size, and what is cut is
    shared again by weight until none is above.  That ends at the level
    ``(budget - caps of the full sources) / weights of the others``, found with
    two running sums over sources by cap per weight.  This is the one step
    that orders all sources, and it has one row for each source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    levels = (
        sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    )
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    return levels.withColumn("final", level).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target"))


def hashed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds the hash digits h0, h1, ... of every document's id."""
    digits = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return docs.withColumns({f"h{k}": F.conv(F.substring(digits, 1 + DIGITS * k, DIGITS), 16, 10).cast("int") for k in range(LEVELS)})


def thresholds(rows: DataFrame, work: Work, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """What every source gives: (of, source_size, target, base, budget, cut, with_cut).

    ``rows`` is (source, size, h0, ...).  ``base`` copies of every document are
    taken and one more of those whose hash is below ``cut``.
    """
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = work.table(targets.withColumn("base", whole).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")), "targets")
    left = plan.select("source", F.col("budget").alias("left"))
    for k in range(LEVELS):
        inside = rows if k == 0 else rows.join(left, rows["source"].eqNullSafe(left["source"]) & _prefix(rows, left, k), "left_semi")
        sums = inside.groupBy("source", f"h{k}").agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy(f"h{k}")
        running = sums.join(left.select(F.col("source").alias("of"), "left"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("upto", F.sum("n").over(upto))
        # The boundary: the first bucket that passes what is left of the budget.
        edge = running.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min_by(F.struct(f"h{k}", (F.col("upto") - F.col("n")).alias("before"), "n"), f"h{k}").alias("e"))
        prior = [f"h{i}" for i in range(k)]
        left = work.table(
            left.drop("n").join(edge.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
            .select("source", *prior, F.col(f"e.h{k}").alias(f"h{k}"), (F.col("left") - F.col("e.before")).alias("left"), F.col("e.n").alias("n")), f"edge{k}",
        )
    # The source's threshold as one number; a source without a boundary takes everything.
    edge = left.select(F.col("source").alias("of"), _number("h").alias("cut"), (F.col("n") - F.col("left") < F.col("left")).alias("with_cut"))
    return work.table(plan.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumnRenamed("source", "of"), "thresholds")


def decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins the few rows of ``plan`` by source and adds ``copies``."""
    more = F.col("cut").isNull() | (_number("h") < F.col("cut")) | ((_number("h") == F.col("cut")) & F.col("with_cut"))
    copies = F.col("base") + F.when((F.col("budget") > 0) & more, 1).otherwise(0)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies.cast("long"))


def sized(docs: DataFrame, work: Work, text: str = "text", key: str = "doc_id") -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), "source", n_words(F.col(text)).alias("size"))
    return work.table(hashed(rows), "sizes")


def mix(docs: DataFrame, work: Work, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """How many words of every document the mix takes.

    Returns doc_id, source, size, source_size, target, copies, taken.  A source
    with target t and size s gives floor(t / s) copies of each document and one
    more of those whose hash lies below the source's threshold.  The threshold
    comes from nested histograms: words summed by source and leading hash
    digits, then the boundary bucket alone by the next digits, LEVELS times;
    the last boundary bucket is taken if that comes nearer the budget.  No
    document is sorted, and lower targets take subsets of higher ones.

    A null or empty text has size 0 and takes nothing; a null source is a
    source of its own; repeated rows of one doc_id share their fate; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = sized(docs, work, text, key)
    out = decided(rows, thresholds(rows, work, weights, share, most))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, work: Work, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, with its columns.  No text is shuffled."""
    plan = thresholds(sized(docs, work), work, weights, share, most).select("of", "base", "budget", "cut", "with_cut")
    own = docs.select(F.struct(*docs.columns).alias("row"), "source", "doc_id")
    taken = decided(hashed(own), plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"))
    return taken.select("row.*")


def _number(prefix: str) -> Column:
    n = F.lit(0).cast("long")
    for k in range(LEVELS):
        n = n * (16**DIGITS) + F.col(f"{prefix}{k}")
    return n


def _prefix(rows: DataFrame, left: DataFrame, k: int) -> Column:
    same = F.lit(True)
    for i in range(k):
        same = same & (rows[f"h{i}"] == left[f"h{i}"])
    return same


def sql() -> str:
    """The same selection by sorting, for DuckDB."""
    return r"""
WITH d AS (
  SELECT doc_id, source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
    ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 9))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, 2.0 * sum(size)::DOUBLE AS cap,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, row_number() OVER w AS pos, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW w AS (ORDER BY cap / weight, encode(source) NULLS LAST)),
f AS (SELECT level FROM l WHERE cap > level * weight ORDER BY pos LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS here
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (base + CASE WHEN budget > 0 AND (upto <= budget OR upto + upto - here < 2 * budget) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r"""
