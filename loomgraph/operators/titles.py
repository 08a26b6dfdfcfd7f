"""Pairs of titles that are alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.udfs import similarity
from .dedup import met
from .work import saved

#: Different titles of a block (fewer, down to LEAST, in up to FEW blocks); pages of one title that meet those of another at once.
BLOCK, LEAST, FEW, PAGES = 1 << 14, 1 << 9, 8, 1 << 8
#: Longest title, without spaces, whose common subsequences are counted in one word of bits.
BITS = 64


def similar_titles(pages: DataFrame) -> DataFrame:
    """(page_id, other_id, similarity) of pages whose titles share a word and are alike, the smaller id first.

    Different titles are compared block against block; after that the pages
    of alike ones meet in small lists, so no task has all pairs of a title.
    """
    rows = pages.select("page_id", "title").distinct()
    words = F.filter(F.array_distinct(F.split(F.lower("title"), r"(?U)\W+")), lambda w: w != "")
    different = saved(rows.select("title").distinct().select("title", words.alias("words")).where(F.size("words") > 0), "titles")
    n = different.count()
    blocks = max(1, -(-n // BLOCK), min(-(-n // LEAST), FEW))
    alike = met(different, None, "title", blocks, _compare, "a string, b string, ahead double, back double")
    alike = saved(alike.union(different.select("title", "title", F.lit(1.0), F.lit(1.0))), "alike")
    nth = F.row_number().over(Window.partitionBy("title").orderBy("page_id")) - 1
    lists = saved(rows.withColumn("part", F.floor(nth / PAGES)).groupBy("title", "part").agg(F.collect_list("page_id").alias("ids")), "lists")
    one = lists.select(F.col("title").alias("a"), F.col("part").alias("p"), F.col("ids").alias("x"))
    two = lists.select(F.col("title").alias("b"), F.col("part").alias("q"), F.col("ids").alias("y"))
    both = alike.join(one, "a").join(two, "b").where("a <> b OR p <= q").repartition("a", "b", "p", "q")
    pairs = both.withColumn("x", F.explode("x")).withColumn("y", F.explode("y")).where("x <> y AND (a <> b OR p < q OR x < y)")
    out = pairs.select(F.least("x", "y").alias("page_id"), F.greatest("x", "y").alias("other_id"), F.when(F.col("x") < F.col("y"), F.col("ahead")).otherwise(F.col("back")).alias("similarity"))
    return out.where(F.col("similarity") >= S.TITLE_SIMILARITY)


def _compare(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
    """(a, b, ahead, back) of different titles that share a word and are alike in one order or the other."""
    titles, others = x["title"].to_pylist(), y["title"].to_pylist()
    plain = [t.lower().replace(" ", "") for t in others]
    sizes = np.array([len(t) for t in plain])
    having: dict[str, list[int]] = {}
    for i, words in enumerate(y["words"].to_pylist()):
        for w in words:
            having.setdefault(w, []).append(i)
    lists = {w: np.array(at) for w, at in having.items()}
    codes = {c: k + 1 for k, c in enumerate(sorted(set("".join(plain))))}
    text = np.zeros((len(others), min(BITS, int(sizes.max()))), dtype=np.int64)
    for i, t in enumerate(plain):
        if len(t) <= BITS:
            text[i, : len(t)] = [codes[c] for c in t]
    found: list[tuple] = []

    def batch():
        a, b, ahead, back = zip(*found, strict=True) if found else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(ahead, pa.float64()), pa.array(back, pa.float64())], ["a", "b", "ahead", "back"])

    for i, (title, words) in enumerate(zip(titles, x["words"].to_pylist(), strict=True)):
        hits = [lists[w] for w in words if w in lists]
        if not hits:
            continue
        likely = np.unique(np.concatenate(hits))
        if x is y:
            likely = likely[likely > i]
        own = title.lower().replace(" ", "")
        # Matching characters are a common subsequence, which has to make up so much of both.
        least = (S.TITLE_SIMILARITY * (len(own) + sizes[likely]) - 1e-9) / 2
        fits = np.minimum(sizes[likely], len(own)) >= least
        likely, least = likely[fits], least[fits]
        if len(own) <= BITS:
            short = sizes[likely] <= BITS
            kept = np.ones(len(likely), dtype=bool)
            kept[short] = _subsequences(own, codes, text[likely[short]]) >= least[short]
            likely = likely[kept]
        for j in likely.tolist():
            ahead, back = similarity(title, others[j]), similarity(others[j], title)
            if max(ahead, back) >= S.TITLE_SIMILARITY:
                found.append((title, others[j], ahead, back))
        if len(found) >= 1 << 16:
            yield batch()
            found = []
    yield batch()


def _subsequences(own: str, codes: dict[str, int], text: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``own``, of up to 64 characters, and each row of coded text (0: end)."""
    where = np.zeros(len(codes) + 1, dtype=np.uint64)
    for k, c in enumerate(own):
        if c in codes:
            where[codes[c]] |= np.uint64(1 << k)
    v = np.full(len(text), ~np.uint64(0))
    for column in text.T:
        u = v & where[column]
        v = (v + u) | (v - u)
    zeros = ~v & np.uint64((1 << len(own)) - 1)
    return np.bitwise_count(zeros).astype(np.int64)
