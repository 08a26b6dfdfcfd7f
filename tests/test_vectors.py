"""Vector pairs: what is copied doesn't grow with the square of the rows, and blocks and tiles give the same."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import dedup


def vectors(spark, n, d=8):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, d)).astype("float32")
    m[n // 2 :: 7] = m[3]  # equal vectors, whose order the ids decide
    m[5] = 0
    ids = rng.permutation(n) * 3
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m, strict=True)] + [(-7, None)], "id long, embedding array<float>"), ids, m


def cosines(m):
    u = m.astype("float64")
    u /= np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-300)
    return np.einsum("ik,jk->ij", u, u)


@pytest.mark.parametrize("small", [False, True])
def test_pairs_and_best(spark, monkeypatch, small):
    if small:  # many blocks and tiles
        monkeypatch.setattr(dedup, "_blocks", lambda n: 5)
    v, ids, m = vectors(spark, 90)
    sims = cosines(m)
    want = {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in zip(*np.nonzero(sims >= 0.5), strict=True) if i != j}
    rows = dedup.similar_pairs(v, 0.5).collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]) for r in rows} == want
    best = dedup.vector_candidates(v.select(F.col("id").alias("query_id"), "embedding"), v.withColumn("status", F.lit("seed")), 0.5, 3, others_only=True).collect()
    expect = set()
    for i in range(len(ids)):
        near = sorted((-round(sims[i, j], 12), int(ids[j])) for j in range(len(ids)) if j != i and sims[i, j] >= 0.5)[:3]
        expect |= {(int(ids[i]), other, k + 1) for k, (_, other) in enumerate(near)}
    assert {(r["query_id"], r["node_id"], r["rank"]) for r in best} == expect


def test_tiles_give_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    table = lambda n, first: pa.table({"id": pa.array(np.arange(n) * 2 + first), "v": pa.array(rng.normal(size=(n, 6)).tolist(), pa.list_(pa.float64()))})
    x, y = table(70, 0), table(50, 1)
    found = lambda k: sorted((r["a"], r["b"], r["similarity"]) for b in dedup._compare(x, y, 0.3, False, k) for r in b.to_pylist())
    want = [found(k) for k in (None, 2)]
    monkeypatch.setattr(dedup, "TILE", (16, 8))
    assert want[0] and want == [found(k) for k in (None, 2)]


def test_copies_of_a_row_stay_few():
    """Ten times the vectors take ten times the rows that are dealt out, up to half a million."""
    assert all(n * dedup._blocks(n) <= 8 * n for n in (1, 10_000, 100_000, 500_000)) and dedup._blocks(6_000_000) <= 92
