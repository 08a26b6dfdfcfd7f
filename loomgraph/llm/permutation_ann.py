"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work

#: Pivots (a bounded sample by hash of the id) and how many nearest ones a vector is posted under.
PIVOTS, PREFIX = 128, 64
#: Share of each block's vectors, nearest by footrule distance, that is compared exactly.
RERANK = 0.3
#: Vectors of a block of the index, and queries that visit a block together.
BLOCK, QUERIES = 8192, 1024


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the PREFIX nearest pivots, nearest first (vectors x prefix)."""
    far = (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :PREFIX].astype(np.uint8)


def posting_lists(order: np.ndarray, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inverted files of a block: for each pivot the rows posted there and the place it has for them."""
    rows, places = np.divmod(np.arange(order.size), order.shape[1])
    by_pivot = np.argsort(order.ravel(), kind="stable")
    ends = np.searchsorted(order.ravel()[by_pivot], np.arange(n_pivots + 1))
    return [(rows[by_pivot[a:b]], places[by_pivot[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def search_block(ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_order: np.ndarray, k: int, n_pivots: int, rerank: float) -> Iterator[tuple]:
    """The k best rows of one block for each query; rows are in ascending id.

    A pivot beyond the prefix counts as place m = len(prefix).  Then the
    footrule distance sum |a - b| is a constant less twice the sum of
    m - max(a, b) over shared pivots, so walking the query's own inverted files
    ranks all rows of the block.
    """
    m, lists = order.shape[1], posting_lists(order, n_pivots)
    keep = min(len(ids), k + 1 + int(np.ceil(rerank * len(ids))))
    for q, vector, pivots in zip(query_ids, queries, query_order, strict=True):
        near = np.zeros(len(ids), dtype=np.int32)
        for place, p in enumerate(pivots):
            rows, places = lists[p]
            near[rows] += m - np.maximum(places, place)
        picked = np.argsort(-near, kind="stable")[:keep]
        picked = picked[ids[picked] != q]
        score = np.sqrt(((vectors[picked] - vector) ** 2).sum(axis=1))
        best = np.lexsort((ids[picked], score))[:k]
        yield q, ids[picked[best]], score[best]


def search(vectors: DataFrame, is_query: Column, work: Work, k: int = 10, rerank: float = RERANK, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """k nearest rows of every query row by Euclidean distance: (query_id, rank, vec_id, score).

    Index: each vector gets its PREFIX nearest of PIVOTS sampled pivots and a
    block of about BLOCK rows by hash.  Queries go to every block in groups of
    QUERIES, so a task holds one block and one group whatever the input.  In a
    block, inverted files rank all rows by footrule distance, the best
    ``rerank`` share is measured exactly, and k rows go on.  Every row is
    indexed; a query misses a neighbour only if its footrule rank in its block
    falls behind that share.  Ties go to the smaller id.

    Null ids, and vectors that are null, zero or hold null or non-finite
    components take no part.  Vectors of another dimension have no distance
    from a query, so each dimension is an index of its own.  Rows of one id
    count once (the least vector by value).  With fewer than k candidates all
    are returned; empty input gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(column)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), is_query.alias("is_query"), F.col(column).cast("array<double>").alias("v"))
    rows = work.table(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query")).withColumn("width", F.size("v")), "vectors")
    drawn = Window.partitionBy("width").orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id")
    sample = rows.select("width", "v", F.row_number().over(drawn).alias("nth")).where(F.col("nth") <= PIVOTS).collect()  # PIVOTS for each dimension
    out = "query_id long, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], out.replace("vec_id", "rank int, vec_id"))
    pivots = {w: np.unique(np.array([r["v"] for r in sample if r["width"] == w]), axis=0) for w in {r["width"] for r in sample}}
    shared = spark.sparkContext.broadcast(pivots)

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width in np.unique(batch["width"].to_numpy()).tolist():
                part = batch.filter(pa.array(batch["width"].to_numpy() == width))
                order = nearest_pivots(matrix(pa.chunked_array([part["v"]])), shared.value[width])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in order], pa.binary())], names=[*part.schema.names, "pivots"])

    index = work.table(rows.mapInArrow(permute, "vec_id long, v array<double>, is_query boolean, width int, pivots binary"), "index")
    # A row for each dimension: how many blocks its vectors make, and how many groups its queries.
    counts = index.groupBy("width").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.count_if("is_query") / QUERIES)).cast("int").alias("groups"))
    sized = index.join(work.table(counts, "counts"), "width")
    place = lambda name, parts: F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    data = sized.select("width", "vec_id", "v", "pivots", place("block", "blocks").alias("block"), every("groups").alias("grp"))
    asked = sized.where("is_query").select(*[F.col(c).alias(c) for c in ("width", "vec_id", "v", "pivots")], place("group", "groups").alias("grp"), every("blocks").alias("block"))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            prefix = lambda t: np.frombuffer(b"".join(t["pivots"].to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
            n_pivots = len(shared.value[left["width"][0].as_py()])
            found = list(search_block(left["vec_id"].to_numpy(), matrix(left["v"]), prefix(left), right["vec_id"].to_numpy(), matrix(right["v"]), prefix(right), k, n_pivots, rerank))
        flat = lambda i, kind: np.concatenate([f[i] for f in found]) if found else np.empty(0, dtype=kind)
        asked_by = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64) if found else np.empty(0, dtype=np.int64)
        return pa.table({"query_id": asked_by, "vec_id": flat(1, np.int64), "score": flat(2, np.float64)})

    near = data.groupBy("width", "block", "grp").cogroup(asked.groupBy("width", "block", "grp")).applyInArrow(rank, out)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
