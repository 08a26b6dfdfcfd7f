"""Entity resolution: exact name, redirect, vector, judgement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import key
from .names import name_index, node_for_page, resolve
from .work import saved


def exact_matches(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds node_id to (name, ...) where a name or alias is equal."""
    return resolve(names, "name", name_index(nodes), "node_id")


def redirect_matches(names: DataFrame, nodes: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds node_id where the name leads to a page of a known node."""
    owner = node_for_page(pages, nodes)
    found = titles.join(owner, ["lang", "page_id"]).select(F.col("key").alias("_key"), "node_id")
    return names.join(found, key(F.col("name")) == F.col("_key"), "left").drop("_key")


#: Vectors that one task holds of each side; fewer, down to LEAST_BLOCK, as long as blocks are no more than FEW_BLOCKS; and rows and columns of one matrix product.
BLOCK, LEAST_BLOCK, FEW_BLOCKS, TILE = 1 << 16, 1 << 10, 8, (1 << 10, 1 << 12)


def _blocks(n: int) -> int:
    """Number of blocks of n vectors: the same for many sizes, so that what is copied grows with the vectors, until blocks are full."""
    return max(1, -(-n // BLOCK), min(-(-n // LEAST_BLOCK), FEW_BLOCKS))


def _unit(v: pa.ChunkedArray) -> np.ndarray:
    rows = v.combine_chunks()
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    if (np.diff(rows.offsets.to_numpy()) != m.shape[1]).any():
        raise ValueError("vectors of different lengths")
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of x and j of y; unlike in a matrix product, they don't depend on where rows stand."""
    step = 1 << 15
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[i[s : s + step]], y[j[s : s + step]]) for s in range(0, len(i), step)]])


def _first(row: np.ndarray, sim: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by row, similarity and other id, and each one's place in its row."""
    order = np.lexsort((other, -sim, row))
    begin = np.flatnonzero(np.diff(row[order], prepend=-1))
    return order, np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))


def _compare(x: pa.Table, y: pa.Table, least: float, same: bool, k: int | None) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) of two blocks: all pairs, or the k best of each row of the first; ``same`` has each pair of one table once."""
    ids, others, u, w = x["id"].to_numpy(), y["id"].to_numpy(), _unit(x["v"]), _unit(y["v"])
    batch = lambda a, b, s: pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})
    # Products in single precision choose; what they may be off by is left in and ruled out in double precision.
    u4, w4, off = u.astype(np.float32), w.astype(np.float32), (u.shape[1] + 8) * 2.0**-23
    for r in range(0, len(ids), TILE[0]):
        best = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
        for c in range(0, len(others), TILE[1]):
            sims = u4[r : r + TILE[0]] @ w4[c : c + TILE[1]].T
            at = np.flatnonzero(sims >= np.float32(least - off))
            s, i, j = sims.reshape(-1)[at], at // sims.shape[1] + r, at % sims.shape[1] + c
            fine = ids[i] < others[j] if same and x is y else ids[i] != others[j]
            s, i, j = s[fine], i[fine], j[fine]
            if k is not None and len(i):  # all that may be among the k best, but for what rounding moves
                order, place = _first(i, s, others[j])
                last = np.full(TILE[0], -np.inf)
                last[i[order][place == k - 1] - r] = s[order][place == k - 1]
                fine = s >= last[i - r] - 2 * off
                i, j = i[fine], j[fine]
            s = _exact(u, w, i, j)
            fine = s >= least
            i, j, s = i[fine], j[fine], s[fine]
            if k is None:
                a, b = ids[i], others[j]
                yield batch(np.minimum(a, b), np.maximum(a, b), s) if same else batch(a, b, s)
            else:
                best = [np.concatenate(p) for p in zip(best, (i, j, s), strict=True)]
                order, place = _first(best[0], best[2], others[best[1]])
                best = [p[order[place < k]] for p in best]
        if k is not None:
            yield batch(ids[best[0]], others[best[1]], best[2])


def _scored(left: DataFrame, right: DataFrame | None, least: float, k: int | None = None) -> DataFrame:
    """(a, b, similarity) of pairs of (id, v) rows with cosine ``least`` or more, a <> b: all, or those that may be the k best of a.

    Without ``right`` each pair of left is there once, a < b.  Rows are dealt
    into blocks by hash; every pair of blocks meets in one task, which goes
    through it in tiles, so it holds two blocks and a tile.  Zero vectors are
    like nothing.
    """
    same = right is None
    left = left.where("v IS NOT NULL")
    right = left if same else right.where("v IS NOT NULL")
    n = _blocks(left.count() if same else max(left.count(), right.count()))
    compare = lambda x, y: _compare(x, y, least, same, k)
    return met(left, None if same else right, "id", n, compare, "a long, b long, similarity double")


def met(left: DataFrame, right: DataFrame | None, key: str, n: int, compare: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``compare`` makes of every pair of the n blocks of each side, one pair in a task.

    Without ``right`` each pair of blocks of left meets once, and a block
    meets itself as one and the same table.
    """
    same = right is None
    at = F.pmod(F.xxhash64(key, F.lit("block")), F.lit(n)).cast("int")
    rows = left.select(at.alias("i"), F.explode(F.sequence(at, F.lit(n - 1)) if same else F.sequence(F.lit(0), F.lit(n - 1))).alias("j"), F.lit(0).alias("side"), *left.columns)
    two = (left.where(at > 0) if same else right).select(F.explode(F.sequence(F.lit(0), at - 1) if same else F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), at.alias("j"), F.lit(1).alias("side"), *left.columns)
    rows = rows.union(two).select((F.col("i") * n + F.col("j")).alias("pair"), "side", *left.columns)

    def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side = table["side"].to_numpy()
        x = table.slice(0, int((side == 0).sum()))
        y = x if same and table["pair"][0].as_py() % (n + 1) == 0 else table.slice(len(x))
        if len(x) and len(y):
            yield from compare(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            pair, begin = batch["pair"].to_numpy(), 0
            for end in [*np.flatnonzero(np.diff(pair)) + 1, len(pair)]:
                if held and held[0]["pair"][0].as_py() != pair[begin]:
                    yield from meet(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(begin, end - begin))
                begin = end
        if held:
            yield from meet(pa.Table.from_batches(held))

    return rows.repartitionById(n * n, F.col("pair")).sortWithinPartitions("pair", "side").mapInArrow(run, schema)


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of (id, embedding) with cosine ``least`` or more."""
    return _scored(vectors.select("id", F.col("embedding").alias("v")), None, least)


def vector_candidates(queries: DataFrame, nodes: DataFrame, least: float = S.VECTOR_SIMILARITY, k: int = 3, others_only: bool = False) -> DataFrame:
    """(query_id, node_id, similarity, rank): the k most similar nodes of each query vector (query_id, embedding).

    With ``others_only`` a query doesn't find the node of its own id.
    """
    vectors = nodes.where("status <> 'rejected'").select("id", F.col("embedding").alias("v"))
    asked = queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("v"))
    if not others_only:  # ids of queries and nodes are unrelated: keep them apart
        asked = asked.withColumn("id", -F.col("id") - 1)
    back = F.col("a") if others_only else -F.col("a") - 1
    scored = _scored(asked, vectors, least, k).select(back.alias("query_id"), F.col("b").alias("node_id"), "similarity")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cascade(names: DataFrame, nodes: DataFrame, pages: DataFrame, titles: DataFrame, judged: DataFrame, least: float = S.VECTOR_SIMILARITY) -> DataFrame:
    """(query_id, name, node_id, how) for candidates (query_id, name, embedding); node_id is null for a new concept.

    Each stage sees only what earlier ones left, and is stored, so that it is
    made once.  ``judged`` (query_id,
    node_id, relation) has the answers on vector candidates: the most similar
    candidate that is the same concept, or that a short name is a facet of,
    decides.
    """
    exact = saved(exact_matches(names, nodes), "exact")
    done = exact.where("node_id IS NOT NULL").select("query_id", "name", "node_id", F.lit("exact").alias("how"))
    redirect = saved(redirect_matches(exact.where("node_id IS NULL").drop("node_id"), nodes, pages, titles), "redirect")
    done = done.union(redirect.where("node_id IS NOT NULL").select("query_id", "name", "node_id", F.lit("redirect")))
    rest = redirect.where("node_id IS NULL").drop("node_id")
    near = vector_candidates(rest.where("embedding IS NOT NULL").select("query_id", "embedding"), nodes, least).join(judged, ["query_id", "node_id"]).join(rest.select("query_id", "name"), "query_id")
    fits = (F.col("relation") == "same") | ((F.col("relation") == "facet") & (F.length("name") <= S.MAX_FACET))
    how = F.format_string("%sembedding(%.2f)+llm", F.when(F.col("relation") == "facet", "facet:").otherwise(""), "similarity")
    best = near.where(fits).groupBy("query_id").agg(F.min_by(F.struct("node_id", how.alias("how")), "rank").alias("b"))
    return done.union(rest.join(best, "query_id", "left").select("query_id", "name", "b.node_id", "b.how"))


def append_missing(array: Column, new: Column) -> Column:
    """``array`` with the elements of ``new`` that it lacks, in order."""
    have = F.coalesce(array, F.array().cast("array<string>"))
    return F.concat(have, F.array_except(F.coalesce(new, F.array().cast("array<string>")), have))


def merge_aliases(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Nodes with resolved names as aliases, or as facets where the match says so."""
    facet = F.coalesce(F.col("how"), F.lit("")).startswith("facet:")
    both = resolved.where("node_id IS NOT NULL").groupBy(F.col("node_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.when(~facet, F.col("name")))).alias("_a"), F.array_sort(F.collect_set(F.when(facet, F.col("name")))).alias("_f")
    )
    out = nodes.join(both, "id", "left")
    own = F.filter("_a", lambda a: key(a) != F.lower(F.col("name")))
    return out.withColumns({"aliases": append_missing(F.col("aliases"), own), "facets": append_missing(F.col("facets"), F.col("_f"))}).select(*nodes.columns)


def missing_embeddings(nodes: DataFrame) -> DataFrame:
    """(id, text) of nodes, not rejected, without a vector."""
    return nodes.where("status <> 'rejected' AND embedding IS NULL").select("id", F.concat("name", F.lit("："), F.coalesce("definition", F.lit(""))).alias("text"))
