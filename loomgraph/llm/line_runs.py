"""Line dedup by a suffix array over line ids, built by prefix doubling (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, with_class

#: Ranks inside one group are counted in at least 2**SLICE_BITS slices, of about
#: SLICE_LINES lines at most, so that a group with a third of all lines is never
#: ordered by a single task.
SLICE_BITS, SLICE_LINES = 10, 100_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _ranked(classes: DataFrame, group: list[str], slice_by: Column, order: list[str]) -> DataFrame:
    """Adds ``below``: suffixes of the same group in classes that come earlier.

    ``classes`` has a row per class with its size ``n``.  Sizes are summed by
    slice first; a window then runs over the slices of a group and
    another inside each slice.
    """
    sliced = classes.withColumn("slice", slice_by)
    totals = sliced.groupBy(*group, "slice").agg(F.sum("n").alias("in_slice"))
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0))).drop("in_slice")
    inside = Window.partitionBy(*group, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sliced.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, [*group, "slice"]).withColumn("below", F.col("before") + F.col("inside")).drop("before", "inside", "slice")


def suffix_levels(rows: DataFrame, work: Work) -> list[DataFrame]:
    """The suffix array of all line sequences, level by level: (doc_id, x, pos, r, first).

    ``rows`` is (doc_id, x, pos, h1, h2) for every line; doc_id and x name a
    text, and a suffix is named by where it begins.  Level t orders suffixes by
    their first 2**t lines: rank r is the number of suffixes below, so each
    doubling only refines inside old groups, by the rank 2**t lines further on.
    Suffixes of equal rank at level t have a longest common prefix of 2**t lines
    or more, so a class is an LCP interval; ``first`` is where it occurs first.
    A suffix alone in its class, or of fewer lines, leaves.  Levels end where
    all ranks are unique.
    """
    here = F.struct("doc_id", "x", "pos")
    # Level 0: ranks of line ids, ordered by hash, with offsets summed by leading hash bits.
    classes = work.table(rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1"), "class0")
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = max(SLICE_BITS, (total // SLICE_LINES).bit_length())
    ranks = _ranked(classes.withColumn("all", F.lit(0)), ["all"], F.shiftrightunsigned("h1", 64 - bits), ["h1", "h2"]).select("h1", "h2", "n", F.col("below").alias("r"), "first")
    width = max(1, total >> bits)
    levels = [work.table(with_class(rows, work.table(ranks, "rank0"), ["h1", "h2"], "n", total).select("doc_id", "x", "pos", "r", "first"), "level0")]
    while True:
        ahead = 1 << (len(levels) - 1)
        further = Window.partitionBy("doc_id", "x").orderBy("pos").rangeBetween(ahead, ahead)
        paired = work.table(levels[-1].select("doc_id", "x", "pos", "r", F.max("r").over(further).alias("r2")).where("r2 IS NOT NULL"), "pairs")
        classes = work.table(paired.groupBy("r", "r2").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1"), "class")
        total = classes.agg(F.sum("n")).first()[0]
        if not total:
            work.drop(paired, classes)
            return levels
        ranks = _ranked(classes, ["r"], F.floor(F.col("r2") / width), ["r2"]).select("r", "r2", "n", (F.col("r") + F.col("below")).alias("to"), "first")
        levels.append(work.table(with_class(paired, work.table(ranks, "rank"), ["r", "r2"], "n", total).select("doc_id", "x", "pos", F.col("to").alias("r"), "first"), "level"))
        work.drop(paired, classes)


def longest_matches(levels: list[DataFrame], work: Work, min_lines: int) -> DataFrame:
    """(here, m, first): the longest match with an earlier suffix, of every suffix where that has ``min_lines`` lines or more.

    Levels are gone through from the longest to single lines.  A suffix enters
    at the first level whose class has an earlier member, and then goes down
    the LCP intervals: in the interval of its m lines, it is grouped by its
    rank 2**t lines at m lines further on, and moves on with those of its group
    that aren't the first there.  An interval is named by its length and its
    first occurrence, which also takes part in it, as what others match; an
    earlier occurrence that has moved on needn't, for the first of its group
    stays and agrees with the others as far.
    """
    here, state = F.struct("doc_id", "x", "pos"), None
    for t in reversed(range(len(levels))):
        size, level = 1 << t, levels[t]
        if state is not None:
            at = level.select(F.struct("doc_id", "x", "pos").alias("at"), "r")
            further = F.struct(F.col("here.doc_id").alias("doc_id"), F.col("here.x").alias("x"), (F.col("here.pos") + F.col("m")).alias("pos"))
            ranked = work.table(state.withColumn("at", further).join(at, "at", "left").drop("at"), "ranked")
            groups = work.table(ranked.where("r IS NOT NULL").groupBy("m", "first", "r").agg(F.min("here").alias("least"), F.count("*").alias("n")).where("n > 1"), "groups")
            total = groups.agg(F.sum("n")).first()[0] or 0
            grouped = with_class(ranked.where("r IS NOT NULL"), groups, ["m", "first", "r"], "n", total, "left")
            on = F.coalesce(F.col("here") > F.col("least"), F.lit(False))
            moved = grouped.select("here", F.when(on, F.col("m") + size).otherwise(F.col("m")).alias("m"), F.when(on, F.col("least")).otherwise(F.col("first")).alias("first"))
            ahead = groups.select(F.col("least").alias("here"), (F.col("m") + size).alias("m"), F.col("least").alias("first"))
            old, state = state, work.table(moved.union(ahead).union(ranked.where("r IS NULL").drop("r")), "state")
            work.drop(old, ranked, groups)
        if 2 * size > min_lines:  # others have fewer lines in common
            new = level.where(F.col("first") < here).select(here.alias("here"), F.lit(size).alias("m"), "first").distinct()
            if state is not None:
                new = new.join(state.where("here <> first").select("here"), "here", "left_anti")
            new = work.table(new, "new")
            firsts = new.groupBy("first").agg(F.max("m").alias("m")).select(F.col("first").alias("here"), "m", "first")
            old, state = state, work.table(new.union(firsts) if state is None else state.union(new).union(firsts), "state")
            work.drop(new, *([] if old is None else [old]))
    if state is None:
        state = work.table(levels[0].select(here.alias("here"), F.lit(0).alias("m"), "first").limit(0), "state")
    return state.where((F.col("here") != F.col("first")) & (F.col("m") >= min_lines))


def repeated_runs(docs: DataFrame, work: Work, min_lines: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Maximal repeated runs that are later copies: (doc_id, x, start, stop, first_doc, first_pos).

    [start, stop) is the longest run of lines from start on that begins
    earlier too, and is left out if it is the end of such a run that starts a
    line before; first_doc and first_pos are where it begins first of all.
    """
    line = F.col("line")
    # Two seeded hashes name a line with 128 bits.
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), text_hash(F.col(text)).alias("x"), F.posexplode(lines_of(F.col(text))).alias("pos", "line")).select(
        "doc_id", "x", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(29), line).alias("h2")
    )
    levels = suffix_levels(work.table(rows, "lines"), work)
    found = longest_matches(levels, work, min_lines)
    work.drop(*levels)
    found = found.select("here.*", "m", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    last = F.lag(F.struct("pos", "m")).over(Window.partitionBy("doc_id", "x").orderBy("pos"))
    inner = F.coalesce((F.col("last.pos") == F.col("pos") - 1) & (F.col("last.m") == F.col("m") + 1), F.lit(False))
    found = found.withColumn("last", last).where(~inner)
    return found.select("doc_id", "x", F.col("pos").alias("start"), (F.col("pos") + F.col("m")).alias("stop"), "first_doc", "first_pos")


def text_hash(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_dedup(docs: DataFrame, work: Work, min_lines: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Deletes every line of a run of ``min_lines`` or more lines that begins earlier.

    Earlier means in a smaller doc_id, or further up in the same document; all
    decisions are made on the input.  Returns for each row of ``docs``: row (a
    struct of all its columns), kept (the text that is left), n_lines,
    n_removed and runs (structs of start, stop, first_doc, first_pos).  The
    struct keeps columns of ``docs`` apart from the others, whatever their
    names.

    A null text has one empty line and stays null unless lines go; a null key
    is kept as it is; repeated rows (one doc_id, one text) are one document and
    treated alike, several texts of one doc_id are documents in the order of
    their hashes; texts are never cut, however long; an empty table gives an
    empty result.
    """
    found = repeated_runs(docs, work, min_lines, text, key)
    by_doc = found.groupBy(F.col("doc_id").alias("of"), F.col("x").alias("of_x")).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "first_doc", "first_pos"))).alias("runs"))
    by_doc = work.table(by_doc, "runs")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), F.col(text).alias("whole"))
    same = (F.col("id") == F.col("of")) & (text_hash(F.col("whole")) == F.col("of_x"))
    rows = rows.join(by_doc.hint("shuffle_hash"), same, "left").withColumn("lines", lines_of(F.col("whole")))
    left = F.filter("lines", lambda x, i: ~F.exists("runs", lambda run: (i >= run["start"]) & (i < run["stop"])))
    rows = rows.withColumn("left", F.when(F.col("runs").isNotNull(), left))
    removed = F.coalesce(F.size("lines") - F.when(F.col("left").isNotNull(), F.size("left")), F.lit(0))
    kept = F.when(removed > 0, F.array_join("left", "\n")).otherwise(F.col("whole"))
    return rows.select("row", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), "runs")


def sql(min_lines: int) -> str:
    """The same deletion by grouping whole windows of lines, for DuckDB."""
    gram = ", ".join(f"lead(line, {i}) OVER w" for i in range(1, min_lines))
    gram = f"[line, {gram}]" if gram else "[line]"
    return f"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
g AS (
  SELECT doc_id, pos, {gram} AS gram, lead(pos, {min_lines - 1}) OVER w AS whole
  FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS nth FROM g WHERE whole IS NOT NULL),
c AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM f, range({min_lines}) t(k) WHERE nth > 1),
k AS (
  SELECT e.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
    string_agg(CASE WHEN c.pos IS NULL THEN line END, chr(10) ORDER BY e.pos) AS kept
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k"""
