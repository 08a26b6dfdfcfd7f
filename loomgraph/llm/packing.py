"""Packing documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import Work
from .tokens import encoder

#: Tokens of a sequence, and of the step to which lengths are rounded up in patterns.
CAPACITY, STEP = 4096, 16
#: Ranks of one length class are counted in at least so many groups, of about so many pieces at most.
GROUPS, GROUP_PIECES = 64, 100_000
#: Column generation ends when the bound shows no more than this share (or one sequence) to gain.
GAP = 5e-4
MOST_COLUMNS = 4000


def pieces(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = CAPACITY, ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token pieces of every document: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    A document is cut every ``capacity`` tokens, so only its last piece is
    shorter; there is no limit to its length.  A null or empty text has just
    the end id; a null key stays null; repeated rows give their pieces each; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = [("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if ids else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for first, flat, at in enc.encode_column(batch["text"], end):
                n = np.diff(at)
                per = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), per)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * capacity
                length = np.minimum(capacity, n[row] - start)
                body, lo = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B"), (at[row] + start) * 4
                crc = [zlib.crc32(body[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
                columns = [batch["doc_id"].take(pa.array(first + row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row])]
                if ids:  # pieces follow one another without gaps
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at[row] + start, at[-1]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(cut, from_arrow_schema(schema))


def best_pattern(value: np.ndarray, width: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the worthiest filling of ``room``."""
    use = np.flatnonzero(value > 1e-12)
    v, w = value[use], width[use]
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = int(np.searchsorted(w, c, side="right"))
        if not fits:
            continue
        total = best[c - w[:fits]] + v[:fits]
        i = int(total.argmax())
        if total[i] > best[c - 1]:
            best[c], took[c] = total[i], i
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(value)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
            continue
        counts[use[took[c]]] += 1
        c -= w[took[c]]
    return float(best[room]), counts


def first_fit(left: np.ndarray, w: np.ndarray, room: int) -> list[tuple[np.ndarray, int, int]]:
    """First-fit decreasing over a histogram: (counts, sequences, a class that this uses up), until none is left."""
    left, out = left.copy(), []
    while left.any():
        counts, space = np.zeros(len(w), dtype=np.int64), room
        for i in np.flatnonzero(left)[::-1]:
            counts[i] = min(left[i], space // w[i])
            space -= counts[i] * w[i]
        some = np.flatnonzero(counts)
        times = left[some] // counts[some]
        left[some] -= counts[some] * times.min()
        out.append((counts, int(times.min()), int(some[times.argmin()])))
    return out


def plan(widths: list[int], demand: list[int], room: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns {width: pieces} with how many sequences follow each, covering ``demand`` exactly.

    The linear program min sum(x) with A x = demand is solved by the revised
    simplex method over patterns.  It starts from first-fit decreasing, whose
    patterns each use up a class and so form a triangular basis; each round
    prices a new column by knapsack with the duals, until Farley's bound is
    within ``gap``.  The solution is rounded down, and what is left (less than
    a sequence for each basic pattern) is packed first-fit decreasing.
    """
    order = np.argsort(widths)
    w, d = np.array(widths, dtype=np.int64)[order], np.array(demand, dtype=np.int64)[order]
    m = len(w)
    if not m:
        return []
    basis, x = np.diag((room // w).astype(np.float64)), np.zeros(m)
    left = d.copy()
    for counts, times, used_up in first_fit(d, w, room):
        whole = left[used_up] == times * counts[used_up]
        left -= counts * times
        if whole and not x[used_up]:
            basis[:, used_up], x[used_up] = counts, times
    inverse = np.linalg.inv(basis)
    x = inverse @ d
    if x.min() < -1e-6:  # a pattern that used up nothing was left out
        basis = np.diag((room // w).astype(np.float64))
        inverse = np.linalg.inv(basis)
        x = inverse @ d
    x = np.maximum(x, 0)
    for turn in range(MOST_COLUMNS):
        if turn % 200 == 199:  # against rounding errors
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ d, 0)
        dual, total = inverse.sum(axis=0), x.sum()
        worth, column = best_pattern(dual, w, room)
        if worth <= 1 + 1e-9 or total - total / worth <= max(gap * total, 0.5):
            break
        step = inverse @ column
        up = step > 1e-10
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = column
    found: list[tuple[dict[int, int], int]] = []
    left = d.copy()

    def use(counts: np.ndarray, n: int) -> None:
        some = np.flatnonzero(counts)
        n = min(n, int((left[some] // counts[some]).min()))
        if n > 0:
            left[some] -= counts[some] * n
            found.append(({int(w[i]): int(counts[i]) for i in some}, n))

    for p in np.flatnonzero(np.floor(x + 1e-9)):
        use(basis[:, p].astype(np.int64), int(x[p] + 1e-9))
    for counts, n, _ in first_fit(left, w, room):
        use(counts, n)
    return found


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, pieces a sequence, first sequence): who takes which ranks of a class."""
    rows, ranks, sequence = [], {}, 0
    for counts, n in patterns:
        for c, per in counts.items():
            lo = ranks.get(c, 0)
            ranks[c] = lo + per * n
            rows.append((c, lo, lo + per * n, per, sequence))
        sequence += n
    return rows


def pack(parts: DataFrame, work: Work, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` tokens.

    Only the histogram of rounded lengths (at most capacity / step rows) goes
    to the driver, and only the slot table (a few rows per pattern, at most
    one pattern per class and residue) comes back; the plan's size does not
    depend on the input.  Pieces are ranked inside their class without sorting
    a class in one task: counts by class and hash group give each group its
    first rank.  A sequence never holds more than ``capacity`` pieces, so the
    window for offsets is bounded.

    Empty tables give empty results; repeated rows are packed separately.
    """
    spark = parts.sparkSession
    groups = max(GROUPS, parts.count() // GROUP_PIECES)
    ranked = parts.withColumn("class", F.ceil(F.col("length") / step).cast("int")).withColumn("grp", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).cast("int"))
    counts = work.table(ranked.groupBy("class", "grp").agg(F.count("*").alias("n")), "counts")
    histogram = counts.groupBy("class").agg(F.sum("n").alias("n")).collect()
    table = slots(plan([r["class"] for r in histogram], [r["n"] for r in histogram], capacity // step))
    plan_rows = spark.createDataFrame(table, "class int, lo long, hi long, per long, first long")
    earlier = Window.partitionBy("class").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "grp", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # Pieces that tie here are equal in all that packing looks at, so any order of them is the same packing.
    inside = Window.partitionBy("class", "grp").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    ranked = work.table(ranked.withColumn("nth", F.row_number().over(inside) - 1), "ranked")  # a task that runs again doesn't rank anew
    ranked = ranked.join(offsets, ["class", "grp"]).withColumn("rank", F.col("before") + F.col("nth"))
    # The slot table has at most a few thousand rows, whatever the input.
    placed = ranked.alias("r").join(F.broadcast(plan_rows).alias("p"), (F.col("r.class") == F.col("p.class")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")))
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("r.class"), "rank")
    offset = F.sum("length").over(in_sequence.rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(*[F.col(f"r.{c}") for c in parts.columns], "sequence_id", F.coalesce(offset, F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, work: Work, tokenizer: str, ids: bool = False, end: int = 2) -> DataFrame:
    """Pieces of all documents, tokenized once into a work table, with their places in sequences."""
    return pack(work.table(pieces(docs, tokenizer, end, ids=ids), "pieces"), work)
