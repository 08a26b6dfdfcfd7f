"""Alike titles: different titles are compared once, whatever number of pages has them."""

import random
import re

import pytest

from loomgraph.functions.udfs import similarity
from loomgraph.operators import titles


def made(seed):
    rng = random.Random(seed)
    base = ["the deep net of the sea", "The Deep Net of the See", "deep q network", "深度 网络 the", "the", " the ", "...", "", None, "x the " * 20, "x the " * 19 + "y the", "c++ the", "naïve the", "İ the", "the deep net"]
    out = base + ["".join(c if rng.random() > 0.1 else rng.choice("xyz ") for c in base[0]) for _ in range(12)]
    return [(k, rng.choice(out) if k > len(out) else out[k % len(out)]) for k in range(60)] + [(3, "the deep net of the lee")]


def words(t):
    return set(re.findall(r"\w+", t.lower())) if t else set()


@pytest.mark.parametrize("small", [False, True])
def test_all_alike_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(titles, "LEAST", 4)
        monkeypatch.setattr(titles, "PAGES", 2)
    rows = made(1)
    want = sorted((i, j, similarity(a, b)) for i, a in set(rows) for j, b in set(rows) if i < j and words(a) & words(b) and similarity(a, b) >= 0.75)
    got = titles.similar_titles(spark.createDataFrame(rows, "page_id long, title string"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert "ArrowEvalPython" not in got._jdf.queryExecution().toString()  # nothing is computed for each pair of pages


def test_subsequences():
    import numpy as np

    rng = random.Random(2)

    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 64))) for _ in range(30)]
    codes = {c: k + 1 for k, c in enumerate("abcd")}
    coded = np.zeros((len(texts), 64), dtype=np.int64)
    for i, t in enumerate(texts):
        coded[i, : len(t)] = [codes[c] for c in t]
    for own in [*texts[:8], "a" * 64, "xax"]:
        assert titles._subsequences(own, codes, coded).tolist() == [lcs(own, t) for t in texts]
