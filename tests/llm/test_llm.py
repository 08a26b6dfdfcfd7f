import collections
import hashlib
import itertools
import math
import os
import random
import textwrap
import time
import types
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import align, audio, idcoder, langid, licenses, line_runs, mixing, order_minhash, packing, permutation_ann, phrases
from loomgraph.llm import queries as Q
from loomgraph.llm.common import Work, components, n_words
from loomgraph.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = b" \t\n\x0b\x0c\r"


def words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


@pytest.fixture(scope="module")
def odd():
    """Nulls, empties, ties, repeated rows, a very long text and letters of many kinds."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choices(vocabulary, k=30_000))
    passage = " ".join(rng.choices(vocabulary, k=70))
    near = passage.split()
    near[30] = "changed"
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (4, "one", "de", "b", 3), (5, "one", "de", "b", 3), (6, "!!! ... 12", "en", "b", 9),
        (7, long, "en", "c", len(long)), (8, "x y " + passage + " tail here", "en", "c", 1), (9, passage, None, "a", 1), (10, " ".join(near), "en", "a", 1),
        (11, "a\nb\nc\nd\n" + passage, "fr", "é", 1), (12, "z\nb\nc\nd\na\nb", "fr", "é", 1), (13, "same " * 400, "fr", "A", 1), (14, "Straße İstanbul ΑΣ. naïve x\x85y <|endoftext|>, É́", "de", "z", 1),
        (15, passage, "en", "a", 1), (15, passage, "en", "a", 1), (None, passage, "en", "a", 1), (16, "MIT License.\nReleased under the MIT  licence", "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, DOCS)


CLASHES = "rep class_id copies h0 of runs lines row told kept size source_size target n_words held_out anchors starts tag seq part grp rank v vec class plan left id key loom_runs start length sequence_id offset digest head".split()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def every_operator(spark):
    t = Q.tokenizer()
    return {
        "pack": lambda d: packing.pack_documents(d, Work(spark, "t"), t), "audio": lambda d: audio.audio_features(d, Work(spark, "t"))[2], "license": lambda d: licenses.scan(d, licenses.known_licenses(spark)),
        "ids": lambda d: idcoder.read_ids(idcoder.write_ids(d, Work(spark, "t"), t)), "near": lambda d: order_minhash.near_duplicates(d, Work(spark, "t")),
        "lines": lambda d: line_runs.line_dedup(d, Work(spark, "t")).select("row.doc_id", "kept", "n_lines", "n_removed", "runs"), "mix": lambda d: mixing.mix(d, Work(spark, "t")),
        "phrases": lambda d: phrases.phrase_dedup(d, Work(spark, "t")), "langid": lambda d: langid.identify(d, langid.fit(d)).select("row.doc_id", "told"),
    }


@pytest.mark.parametrize("name", ["pack", "audio", "license", "ids", "near", "lines", "mix", "phrases", "langid"])
def test_odd_clashing_and_empty_tables(spark, docs, clashing, empty, name):
    run = every_operator(spark)[name]
    plain = run(docs)
    assert rows_of(plain, *plain.columns) == rows_of(run(clashing), *plain.columns)
    assert run(empty).columns == plain.columns and run(empty).count() == 0
    n = plain.count()
    assert n >= 18 if name == "pack" else n == 18


# --- tokens, packing, id files -------------------------------------------------------------------


def test_tokens_equal_the_library(odd):
    e = encoder(Q.tokenizer())
    assert not e.whole
    texts = [r[1] for r in odd] + ["a,b. c,, d.. 'S don't I'LL x'", "<|STARTOFTEXT|> <|startoftext|>.", " nbsp　x", "ﬁ ² ½ ª"]
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want
    assert [x.tolist() for x in e.encode(texts, 2)] == [[*w, 2] for w in want]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_tokens_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    e = encoder(Q.tokenizer())
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def ids_of(odd):
    e = encoder(Q.tokenizer())
    return {r[0]: [*ids, 2] for r, ids in zip(odd, (x.ids for x in e.tokenizer.encode_batch([r[1] or "" for r in odd], add_special_tokens=False)), strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing_covers_every_id_once(spark, docs, odd):
    want = ids_of(odd)
    sequences, seen = collections.defaultdict(list), collections.Counter()
    for r in packing.pack_documents(docs, Work(spark, "t"), Q.tokenizer(), ids=True).collect():
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["ids_crc32"], r["doc_tokens"], r["ids"]) == (crc(part), len(want[r["doc_id"]]), part)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
    copies = collections.Counter(r[0] for r in odd)
    assert seen == {d: len(ids) * copies[d] for d, ids in want.items()}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= 4096


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=12))
def test_cutting_stock_plan(demand):
    found = packing.plan(list(demand), list(demand.values()), 32)
    made = collections.Counter()
    for counts, n in found:
        assert n > 0 and sum(w * k for w, k in counts.items()) <= 32
        for w, k in counts.items():
            made[w] += k * n
    assert made == demand
    need = -(-sum(w * n for w, n in demand.items()) // 32)
    assert sum(n for _, n in found) <= 1.25 * need + 2 + sum(n for w, n in demand.items() if w > 16)
    assert sum(hi - lo for _, lo, hi, _, _ in packing.slots(found)) == sum(demand.values())


def test_padding_is_small(spark):
    out = Q.op1_pack(spark, "/root/testdata/sf0.01").groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.count("*")).first()
    assert out[0] / (4096 * out[1]) > 0.98


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=5000), st.integers(1, 3))
def test_id_coder_round_trip(ids, repeat):
    ids = np.array(ids * repeat, dtype=np.uint32)
    n = np.array([len(ids)], dtype=np.int64)
    keys, counts, back = idcoder.decode_segment(idcoder.encode_segment(np.array([7]), n, ids))
    assert keys.tolist() == [7] and counts.tolist() == [len(ids)] and (back == ids).all()


def test_id_coder_learns_and_checks():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 49_000, 300), 60).astype(np.uint32)
    body = idcoder.encode_segment(np.array([1]), np.array([len(ids)]), ids)
    assert len(body) < len(ids) * 2 / 3
    with pytest.raises(ValueError):
        idcoder.decode_segment(body[:-40] + bytes(40))
    with pytest.raises(ValueError):
        idcoder.decode_segment(b"x" + body[1:])


def test_id_files(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(idcoder, "LANES", 4)
    want, copies, start = ids_of(odd), collections.Counter(r[0] for r in odd), 0
    files = idcoder.write_ids(docs, Work(spark, "t"), Q.tokenizer())
    got = sorted((tuple(r) for r in idcoder.read_ids(files, ids=True).collect()), key=lambda r: r[1])
    for d, at, n, c, ids in got:
        assert (at, n, c, ids) == (start, len(want[d]), crc(want[d]), want[d])
        start += n
    assert [r[0] for r in got] == [None, *sorted(d for d in copies.elements() if d is not None)]
    paths = [Path(r["file"].removeprefix("file://")) for r in files.orderBy("part", "seq").collect()]
    assert sorted(paths) == sorted(paths[0].parent.iterdir()) == paths
    stored = [idcoder.decode_segment(p.read_bytes()) for p in paths]
    assert [i for _, _, ids in stored for i in ids.tolist()] == [i for r in got for i in r[4]]


def test_id_segment_keeps_its_bytes():
    i = np.arange(30_000)
    ids = np.where(i % 5 < 2, i % 300, i * i % 49_999).astype(np.uint32)
    ids[20_000:20_010] = (1 << 30) - 1
    body = idcoder.encode_segment(np.array([7, 9]), np.array([10_000, 20_000]), ids)
    assert hashlib.sha256(body).hexdigest() == "6c67ee51c3fe3321fe7ecdbba3994f0cb17016b5ba85052f1026c7f301136f63"
    assert (idcoder.decode_segment(body)[2] == ids).all()


def test_ids_of_one_task_are_coded_in_one_go(spark):
    """Tasks of the check have about six million ids; two segments for them would cost nearly twice the steps."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        files = idcoder.write_ids(spark.range(5).select(F.col("id").alias("doc_id"), F.expr("repeat('the of and ', 350000)").alias("text")), Work(spark, "t"), Q.tokenizer())
        want = [*encoder(Q.tokenizer()).tokenizer.encode("the of and", add_special_tokens=False).ids * 350_000, 2]
        assert [(r["n_docs"], r["n_ids"]) for r in files.collect()] == [(5, 5 * len(want))] and len(want) > 1_000_000
        got = idcoder.read_ids(files).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert [tuple(r) for r in got] == [(d, d * len(want), len(want), crc(want)) for d in range(5)]


# --- audio and licences ---------------------------------------------------------------------------


def slow_features(payload):
    """Log-mel energies and segments by definition: a windowed sinc for each sample, a Fourier sum for each bin, loops for segments."""
    x = [(v - 128) / 128 for v in payload]
    n_out = -(-len(x) * 5 // 8)
    frames = max(1, -(-(n_out - 256 + 128) // 128))

    def sample(k):
        where, total, weights = k * 8 / 5, 0.0, 0.0
        for i in range(math.floor(where) - 7, math.floor(where) + 9):
            t = i - where
            w = 0.625 * np.sinc(0.625 * t) * (0.5 + 0.5 * np.cos(np.pi * t / 8) if abs(t) <= 8 else 0.0)
            weights += w
            total += w * (x[i] if 0 <= i < len(x) else 0.0)
        return total / weights

    y = np.array([sample(k) for k in range((frames - 1) * 128 + 256)])
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    fourier = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    hz = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 40 / 700), 2595 * np.log10(1 + 5000 / 700), 26) / 2595) - 1)
    mels, energy = np.empty((frames, 24)), np.empty(frames)
    for f in range(frames):
        own = y[128 * f : 128 * f + 256] * taper
        power, bins = np.abs(fourier @ own) ** 2, np.arange(129) * 10_000 / 256
        for m in range(24):
            low, top, high = hz[m : m + 3]
            mels[f, m] = np.log(sum(p * max(0.0, min((b - low) / (top - low), (high - b) / (high - top))) for p, b in zip(power, bins)) + 1e-10)
        energy[f] = 10 * np.log10((own**2).mean() + 1e-10)
    middle, runs, start, loud = np.median(energy), [], None, False
    for f, e in enumerate([*energy, -np.inf]):
        if e >= middle + 0.2:
            start, loud = f if start is None else start, loud or e >= middle + 0.5
        else:
            if start is not None and loud:
                runs.append((start, f))
            start, loud = None, False
    return mels, runs


def test_audio_is_lossless(spark, docs, odd):
    raw = {r[0]: (r[1] or "").encode() for r in odd}
    media, features, summary = audio.audio_features(docs, Work(spark, "t"))
    stored = {r["media_sha256"]: r for r in features.collect()}
    files = {hashlib.sha256(r["media"]).hexdigest(): bytes(r["media"]) for r in media.collect()}
    assert summary.count() == features.count() == media.count() == len(odd)
    for r in summary.collect():
        body = raw[r["doc_id"]]
        payload = body + bytes(-len(body) % 64 if body else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert audio.load(files[r["media_sha256"]]) == payload and r["media_bytes"] == len(files[r["media_sha256"]])
        found = stored[r["media_sha256"]]
        tensors, spans = audio.read_tensors(bytes(found["log_mel"]))
        assert tensors.shape[1:] == (audio.WINDOW, audio.MELS) and (np.diff(spans[:, 0]) > 0).all() and spans[-1, 1] >= len(payload) / audio.RATE - 0.03
        assert all(0 <= s["start_s"] < s["stop_s"] <= spans[-1, 1] + 1e-9 for s in found["segments"])
        if len(payload) < 3000:
            mels, runs = slow_features(payload)
            flat = tensors.reshape(-1, audio.MELS)
            assert np.allclose(flat[: len(mels)], mels, atol=0.01, rtol=1e-3) and (flat[len(mels) :] == np.float16(np.log(audio.FLOOR))).all()
            assert [(s["start"], s["stop"]) for s in found["segments"]] == runs
            padded = np.full(tensors.shape, np.float16(np.log(audio.FLOOR))).reshape(-1, audio.MELS)
            padded[: len(mels)] = mels
            assert r["feature"] == audio.feature_digest(padded.reshape(tensors.shape), spans, np.array(runs, dtype=np.int64).reshape(-1, 2))


def test_audio_finds_a_tone():
    t = np.arange(16_000) / audio.RATE
    wave = np.where((t > 0.3) & (t < 0.6), 100 * np.sin(2 * np.pi * 1000 * t), 2 * np.sin(2 * np.pi * 300 * t)) + 128
    mels, energy = audio.log_mel(np.rint(wave).astype(np.uint8).tobytes())
    runs = audio.segments(energy)
    assert len(runs) == 1 and abs(runs[0][0] * audio.HOP / audio.FEATURE_RATE - 0.3) < 0.05 and abs(runs[0][1] * audio.HOP / audio.FEATURE_RATE - 0.6) < 0.05
    edges = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 40 / 700), 2595 * np.log10(1 + audio.FEATURE_RATE / 1400), audio.MELS + 2) / 2595) - 1)
    loudest = int(mels[len(mels) * 45 // 100].argmax())
    assert edges[loudest] <= 1000 <= edges[loudest + 2]


def test_audio_pieces_agree(monkeypatch):
    body = np.random.default_rng(0).integers(0, 256, 64_000, dtype=np.uint8).tobytes()
    whole = audio.log_mel(body)
    monkeypatch.setattr(audio, "PIECE", 50)
    parts = audio.log_mel(body)
    assert np.allclose(whole[0], parts[0], atol=1e-3) and np.allclose(whole[1], parts[1], atol=1e-3)


def test_licenses(spark):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    body = next(t for i, t in licenses.KNOWN if i == "MIT")
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + body.upper().replace('"', "“")), (2, body + " more"), (3, "text\n// released under the  MIT LICENCE!\nmore"), (4, None), (5, ""), (6, "(C) only\nAll rights reserved."), (7, "Licensed under the Apache License, Version 2.0\nLicensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()}
    assert mit and got == {1: ("MIT", None), 2: (None, None), 3: (None, "MIT"), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, "Apache-2.0,CC-BY-NC-4.0")}
    other = spark.createDataFrame([("L1", "sub-licence it"), ("L2", "Sublicense IT.")], "license_id string, text string")
    twice = spark.createDataFrame([("L", "license license Licence centre")], "license_id string, text string")
    assert licenses.scan(spark.createDataFrame([(1, "Licence licence license; center")], "doc_id long, text string"), twice).first()["license"] == "L"
    assert licenses.scan(spark.createDataFrame([(1, "x\nSub Licence it")], "doc_id long, text string"), other).first()["notices"] == "L1,L2"


def test_licences_at_any_wrap_width(spark):
    rows, want = [], {}
    for name, text in licenses.KNOWN:
        for width in range(24, 100, 3):
            want[len(rows)] = name
            wrapped = "\n".join("\n".join(textwrap.wrap(line, width, break_on_hyphens=False, break_long_words=False)) for line in text.split("\n"))
            rows.append((len(rows), "Copyright (c) 2020 Some One\n" + wrapped))
    heads = ["Copyright 2019-2020 Acme", "(c) Acme Inc.", "© Jane Doe", "Copyright Jane Doe", "// Copyright by X", "Copyright (C) <year> <owner>", "Copyright holder: Jane", "All rights reserved."]
    for head in heads:
        want[len(rows)] = "MIT"
        rows.append((len(rows), head + "\n" + licenses.KNOWN[0][1]))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark))
    assert {r["doc_id"]: r["license"] for r in got.collect()} == want


# --- near duplicates ------------------------------------------------------------------------------


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 12))
def test_banded_alignment(a, b, most):
    assert align.edit_distance(a, b, most) == min(slow_distance(a, b), most + 1)


def classes_by_force(texts):
    tokens = {d: (t or "").encode().split() for d, t in texts.items()}
    label = {d: d for d in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if tokens[a] and tokens[b] and align.similarity(tokens[a], tokens[b], 0.8) >= 0.8:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {d: new if x == old else x for d, x in label.items()}
    return label


def test_near_duplicates_by_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(500)]
    texts, n = {}, 0
    for group in range(30):
        base = rng.choices(vocabulary, k=rng.randint(40, 300))
        for copy in range(rng.choice([1, 2, 3, 30])):
            own = list(base)
            for _ in range(0 if copy == 0 else len(base) // 25):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts[n] = "  ".join(own) if copy % 2 else "\n".join(own)
            n += 1
    ids = list(texts)
    rng.shuffle(ids)
    texts = {ids[i]: t for i, t in texts.items()}
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), Work(spark, "t")).collect()}
    assert got == classes_by_force(texts)


def test_near_duplicates_of_odd_texts(spark, docs):
    got = dict(rows_of(order_minhash.near_duplicates(docs, Work(spark, "t")).where("doc_id IS NOT NULL").distinct(), "doc_id", "class_id"))
    assert [got[i] for i in (1, 2, 3, 4, 5, 9, 10, 15, 13)] == [1, 2, 3, 4, 4, 8, 8, 8, 13]


def test_near_duplicates_with_one_id_for_several_texts(spark):
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    rows = [(7, a), (7, b), (7, c), (8, a[:-1]), (9, ["new", *b]), (3, [*c, "end"]), (None, b), (None, ["alone"] * 9)]
    out = order_minhash.near_duplicates(spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string"), Work(spark, "t"))
    assert rows_of(out, "doc_id", "copy_of", "class_id") == sorted([(7, 7, 7), (7, 7, 7), (7, 7, 3), (8, 8, 7), (9, 9, 7), (3, 3, 3), (None, 7, 7), (None, None, None)], key=repr)


def test_star_family_in_crowded_buckets(spark):
    rng = random.Random(8)
    base, texts = [f"b{i}" for i in range(200)], {}
    for d in range(300):  # each aligns with the base alone, whose id is the largest
        own = list(base)
        for at in rng.sample(range(0, 200, 8), 6):
            own[at : at + 6] = [f"x{d}.{at}.{i}" for i in range(6)]
        texts[d] = " ".join(own)
    texts[1000] = " ".join(base)
    tokens = {d: t.encode().split() for d, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bands = {r["doc_id"]: set(r["bands"]) for r in order_minhash.sketches(df.withColumn("x", F.lit(0).cast("long"))).select("doc_id", "bands").collect()}
    links = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if bands[a] & bands[b] and align.similarity(tokens[a], tokens[b], 0.8) >= 0.8]
    label = {d: d for d in texts}
    for _ in range(3):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(df, Work(spark, "t")).collect()}
    assert got == label and len(set(label.values())) < 100


def test_larger_buckets_have_all_their_hubs(spark):
    texts = spark.createDataFrame([(i, 100, [7]) for i in range(60)], "node long, n_words long, bands array<long>")
    pairs = order_minhash.candidates(texts, Work(spark, "t"))[0].collect()
    degree = collections.Counter(x for r in pairs for x in (r["a"], r["b"]))
    assert sum(n == 59 for n in degree.values()) == order_minhash.HUBS


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=14), st.lists(st.sampled_from("abcdef"), max_size=14))
def test_histograms_never_rule_out_too_much(a, b):
    cells = [np.bincount([ord(x) % 4 for x in t], minlength=4)[None, :].astype(np.uint8) for t in (a, b)]
    assert order_minhash.least_edits(*cells)[0, 0] <= slow_distance(a, b)


def test_order_matters():
    x = np.random.default_rng(3).integers(1, 2**63, 400).astype(np.uint64)
    turned = np.concatenate([x[200:], x[:200]])
    same = (order_minhash.sketch(x) == order_minhash.sketch(turned)).mean()
    assert same < 0.7 and (order_minhash.sketch(x) == order_minhash.sketch(x.copy())).all()


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 201), (199, 201), (5, 300)]
    links += [(400 + rng.randint(0, 60), 470 + rng.randint(0, 60)) for _ in range(70)]
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([(min(e), max(e)) for e in links], "a long, b long")
    assert dict(rows_of(components(Work(spark, "t"), df), "node", "label")) == label
    assert components(Work(spark, "t"), df.limit(0)).count() == 0


# --- lines, mixing, phrases -----------------------------------------------------------------------


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_runs_by_force(spark, least):
    rng = random.Random(least)
    texts = {d: "\n".join(rng.choice("abcde") if rng.random() < 0.7 else f"u{rng.random()}" for _ in range(rng.randint(0, 25))) for d in range(25)}
    seen, want = {}, {}
    gone = collections.defaultdict(set)
    for d in sorted(texts):
        rows = texts[d].split("\n")
        for i in range(len(rows) - least + 1):
            run = tuple(rows[i : i + least])
            if run in seen:
                gone[d] |= set(range(i, i + least))
            seen.setdefault(run, (d, i))
        want[d] = "\n".join(x for i, x in enumerate(rows) if i not in gone[d])
    out = line_runs.line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), Work(spark, "t"), least).collect()
    assert {r["row"]["doc_id"]: r["kept"] for r in out} == want
    assert {(r["row"]["doc_id"], *run) for r in out for run in r["runs"] or []} == runs_by_force(texts, least)


def runs_by_force(texts, least):
    """Maximal runs that begin earlier too, with where they begin first."""
    suffixes = [(d, i, texts[d].split("\n")[i:]) for d in sorted(texts) for i in range(texts[d].count("\n") + 1)]
    longest = {}
    for k, (d, i, own) in enumerate(suffixes):
        best = (0, None, None)
        for e, j, other in suffixes[:k]:
            same = next((n for n, (x, y) in enumerate(zip(own, other)) if x != y), min(len(own), len(other)))
            if same > best[0]:
                best = (same, e, j)
        longest[d, i] = best
    return {(d, i, i + n, e, j) for (d, i), (n, e, j) in longest.items() if n >= least and longest.get((d, i - 1), (0,))[0] != n + 1}


def test_line_runs_inside_long_copies(spark):
    rng = random.Random(1)
    base = [rng.choice("abc") for _ in range(40)]
    texts = {1: "\n".join(base), 2: "\n".join(base[5:30] + ["u"] + base[3:17]), 3: "\n".join(["x"] * 21), 4: "\n".join(base), 5: "\n".join(base[20:] + ["x"] * 9), 6: "a", 7: ""}
    out = line_runs.line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), Work(spark, "t"), 2).collect()
    assert {(r["row"]["doc_id"], *run) for r in out for run in r["runs"] or []} == runs_by_force(texts, 2)
    assert {r["row"]["doc_id"]: r["kept"] for r in out}[4] == ""


def test_lines_with_one_id_for_two_texts(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nx"), (2, "q\nr\ns"), (2, "q\nr\ns"), (3, "q\nr")]
    out = line_runs.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), Work(spark, "t"), 2)
    assert sorted((r["row"]["doc_id"], r["kept"]) for r in out.collect()) == [(1, "a\nb\nc"), (2, "q\nr\ns"), (2, "q\nr\ns"), (2, "x"), (3, "")]


def test_mixing_meets_targets(spark, odd, docs):
    got = mixing.mix(docs, Work(spark, "t")).collect()
    size = {r[0]: len(words(r[1])) for r in odd}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2 for r in got)
    names = sorted({r[3] for r in odd if r[3] is not None}) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = collections.Counter()
    for r in odd:
        total[r[3]] += size[r[0]]
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 for r in got)


def test_mix_repeats_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(d, Work(spark, "t")).collect()}
    out = mixing.mixed(d, Work(spark, "t"))
    assert out.columns == d.columns
    got = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert got == {k: v for k, v in want.items() if v}


def test_word_counts(spark, odd, docs):
    assert rows_of(docs.select("doc_id", n_words(F.col("text")).alias("n")), "doc_id", "n") == sorted(((r[0], len(words(r[1]))) for r in odd), key=repr)


def test_phrases_by_force(spark, docs, odd):
    first = {}
    for r in odd:
        w = words(r[1])
        for i in range(len(w) - 49):
            if r[0] is not None:
                key = tuple(w[i : i + 50])
                first[key] = min(first.get(key, r[0]), r[0])
    want = []
    for r in odd:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 49):
            if r[0] is not None and first[tuple(w[i : i + 50])] < r[0]:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    out = phrases.phrase_dedup(docs, Work(spark, "t"))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out.collect())


def test_phrases_with_one_id_for_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = spark.createDataFrame([(1, a), (2, a + " x"), (2, b), (3, "y " + b)], "doc_id long, text string")
    assert rows_of(phrases.phrase_dedup(rows, Work(spark, "t")), "doc_id", "n_words", "n_removed") == [(1, 60, 0), (2, 60, 0), (2, 61, 60), (3, 61, 60)]


def test_phrases_leave_no_shuffle_files_of_finished_steps(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
    blocks = lambda: {x for x in env.diskBlockManager().getAllBlocks().mkString(" ").split() if x.endswith(".data")}
    size = lambda names: sum(os.path.getsize(f) for f in env.diskBlockManager().getAllFiles().mkString(" ").split() if os.path.basename(f) in names)

    class Watched(Work):
        def table(self, *args, **kwargs):
            out, end = super().table(*args, **kwargs), time.monotonic() + 10
            while size(blocks() - before) > 20_000 and time.monotonic() < end:
                time.sleep(0.2)
            left.append(size(blocks() - before))
            return out

    passages = [" ".join(f"p{i}w{k}" for k in range(60)) for i in range(40)]
    rows = [(i, " ".join([*(f"d{i}w{k}" for k in range(200)), passages[i % 40]])) for i in range(400)]
    work, left = Watched(spark, "t"), []
    jvm = types.SimpleNamespace(System=types.SimpleNamespace(gc=lambda: None), org=spark._jvm.org)  # garbage is not collected
    work.spark = types.SimpleNamespace(read=spark.read, conf=spark.conf, _jvm=jvm, _jsc=spark._jsc)
    before = blocks()
    out = phrases.phrase_dedup(spark.createDataFrame(rows, "doc_id long, text string"), work)
    assert rows_of(out, "doc_id", "n_removed") == sorted(((i, 60 if i >= 40 else 0) for i in range(400)), key=repr)
    assert len(left) == 7 and max(left) < 20_000


# --- language and vectors -------------------------------------------------------------------------


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in Q.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    got = Q.op9_langid(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_of_odd_texts(spark, docs):
    told = {r["id"]: r["lang"] for r in langid.identify(docs, langid.fit(docs)).select("row.doc_id", "told.lang").toDF("id", "lang").collect()}
    assert [told[i] for i in (1, 2, 3, 6)] == [langid.UNKNOWN] * 4 and told[4] in ("de", "en", "fr")


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "Größe " * 500
    whole = np.sort(np.concatenate(list(langid.features(text))))
    monkeypatch.setattr(langid, "PIECE", 64)
    assert (np.sort(np.concatenate(list(langid.features(text)))) == whole).all()


def exact_neighbours(vectors, k=10):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    out = {}
    for i in ids[ids % 100 == 0]:
        d = np.sqrt(((x - vectors[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(ids[j], d[j]) for j in order]
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in Q.table(spark, sf, "embeddings").collect()}
    want, got = exact_neighbours(vectors), collections.defaultdict(list)
    for r in Q.op10_ann(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert abs(r["score"] - np.sqrt(((vectors[r["query_id"]] - vectors[r["vec_id"]]) ** 2).sum())) < 1e-12
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [0.0, 2.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    out = permutation_ann.search(df, F.col("vec_id") % 100 == 0, Work(spark, "t"), rerank=1.0)
    assert rows_of(out, "query_id", "rank", "vec_id") == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 9), (100, 1, 9), (100, 2, 0), (100, 3, 1), (100, 4, 2)]
    wider = df.union(spark.createDataFrame([(i, [1.0, 0.0, float(i)], "clash") for i in (200, 201, 202)], df.schema))
    assert rows_of(permutation_ann.search(wider, F.col("vec_id") % 100 == 0, Work(spark, "t"), rerank=1.0).where("query_id = 200"), "rank", "vec_id") == [(1, 201), (2, 202)]
    assert permutation_ann.search(wider, F.col("vec_id") % 100 == 0, Work(spark, "t"), rerank=1.0).count() == out.count() + 2
    assert permutation_ann.search(df.limit(0), F.col("vec_id") % 100 == 0, Work(spark, "t")).count() == 0


def test_footrule_by_inverted_files():
    rng = np.random.default_rng(0)
    x, pivots = rng.normal(size=(300, 8)), rng.normal(size=(20, 8))
    order = permutation_ann.nearest_pivots(x, pivots)[:, :6]
    lists = permutation_ann.posting_lists(order, 20)
    place = np.full((300, 20), 6)
    np.put_along_axis(place, order.astype(int), np.arange(6)[None, :], axis=1)
    near = np.zeros(300, dtype=int)
    for i, p in enumerate(order[0]):
        rows, places = lists[p]
        near[rows] += 6 - np.maximum(places, i)
    footrule = np.abs(place - place[0]).sum(axis=1)
    assert (footrule + 2 * near == footrule[0] + 2 * near[0]).all()
