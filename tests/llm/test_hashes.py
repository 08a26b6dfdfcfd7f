"""Inputs that weak hashes confuse: Thue-Morse words and texts, and words of one code."""

import hashlib

import numpy as np
import pytest

from loomgraph.llm import align, order_minhash, phrases, tokens, wordhash
from loomgraph.llm import queries as Q
from loomgraph.llm.common import Work


def thue_morse(n, a, b):
    return [(a, b)[i.bit_count() % 2] for i in range(n)]


def test_words_that_polynomials_confuse():
    e = tokens.WordEncoder(Q.tokenizer())
    for n in (64, 250, 1024, 4096):
        texts = ["".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))]
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in e.encode([" ".join(texts)])] == [want[0] + want[1]]
        assert [e.encode([t])[0].tolist() for t in texts] == want


def test_words_of_one_code_are_told_apart(monkeypatch):
    monkeypatch.setattr(wordhash, "word_codes", lambda body, start, end: (np.full(len(start), 7, dtype=np.uint64), wordhash._lane(wordhash.eights(body), start, end - start)))
    e = tokens.WordEncoder(Q.tokenizer())
    e.whole = False
    texts = ["one two", "two", "one", "abcdefghij abcdefghik", "abcdefghij", "abcdefghik"]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want
    assert [e.encode([t])[0].tolist() for t in texts] == want


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 255, 256, 257, 264, 300, 1000])
def test_same_words_looks_at_every_byte(size):
    rng = np.random.default_rng(size)
    a = rng.integers(97, 123, 3 * size + 40, dtype=np.uint8)
    b = a.copy()
    b[2 * size + 10 - 1] ^= 1
    at, n = np.array([0, size + 10]), np.array([size, size])
    assert wordhash.same_words(a, at, b, at, n).tolist() == [True, False]
    codes = [wordhash.word_codes(x, at, at + n)[0] for x in (a, b)]
    assert codes[0][0] == codes[1][0] and codes[0][1] != codes[1][1]


def test_run_hashes_are_those_of_the_run_alone():
    codes = np.random.default_rng(0).integers(0, 2**63, 90).astype(np.uint64)
    for k in (1, 2, 5, 20, 50, 64):
        whole = wordhash.run_hashes(codes, k, 3)
        assert len(whole) == 91 - k and all(whole[i] == wordhash.run_hashes(codes[i : i + k], k, 3)[0] for i in range(91 - k))


def test_texts_that_polynomials_confuse(spark):
    first, second = (" ".join(f"f{i} {x}" for i, x in enumerate(thue_morse(2048, a, b))) for a, b in (("t0", "t1"), ("t1", "t0")))
    third = " ".join(thue_morse(4096, "t0", "t1"))
    fourth = " ".join(thue_morse(4096, "t1", "t0"))
    docs = spark.createDataFrame([(1, first), (2, second), (3, third), (4, fourth)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in phrases.phrase_dedup(docs, Work(spark, "t")).collect()}
    assert got[2]["n_removed"] == 0 and got[2]["kept_sha256"] == hashlib.sha256(second.encode()).hexdigest()
    seen, words, gone = {tuple(third.split()[i : i + 50]) for i in range(4047)}, fourth.split(), set()
    for i in range(4047):
        if tuple(words[i : i + 50]) in seen:
            gone |= set(range(i, i + 50))
    assert got[4]["n_removed"] == len(gone)
    assert {r["doc_id"]: r["copy_of"] for r in order_minhash.near_duplicates(docs, Work(spark, "t")).collect()} == {i: i for i in range(1, 5)}


def test_a_text_of_very_many_different_words(spark):
    words = [f"w{i:x}" for i in range(1_500_000)]
    near = list(words)
    near[700_000] = "other"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "few words")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in phrases.phrase_dedup(docs, Work(spark, "t")).collect()}
    assert got == {1: (1_500_000, 0), 2: (1_500_000, 1_499_999), 3: (2, 0)}


def test_long_near_copies_align_in_bounded_memory():
    import tracemalloc

    a = [b"w%d" % i for i in range(300_000)]
    b = [b"first", *a[1:100_000], *a[100_005:-1], b"last"]
    tracemalloc.start()
    assert align.edit_distance(a, b, 60_000) == 7
    assert align.edit_distance(a[:3000] * 2, a[1500:3000] + a[:4500], 200) == 201
    repetitive = [b"x", b"y", b"z"] * 2000
    assert align.edit_distance(repetitive, repetitive[5:-7] + [b"q"], 1000) == 12
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
