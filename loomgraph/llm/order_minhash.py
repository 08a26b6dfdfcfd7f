"""Near-duplicate classes by Order MinHash and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import similarity
from .common import Work, components, with_class
from .wordhash import SEEDS, U, Words, buffers, mix, run_hashes, sequence_digests, slices, words_of

#: Words of a k-mer, least similarity of a link, k-mers kept by a sketch.
SHINGLE, LEAST, KEPT = 5, 0.8, 2
#: Bands of a document, and the sketches that must agree in one.
BANDS, PER_BAND = 40, 1
#: Buckets up to this size are compared pair by pair at once; larger ones through hubs first.
SMALL = 8
#: Hubs of a larger bucket, at most, and hubs of all its larger buckets that a text is aligned with at once.
HUBS = 3
#: Members of a larger bucket that meet as one block, on average at most.
BLOCK = 512
#: Cells of a text's word histogram, and those that are left when they are folded for a first look.
CELLS, FOLDED = 2048, 256
#: Pairs of two classes that two blocks align in the first round, and by how much that grows each round.
FIRST, MORE = 16, 64
#: Partners of a hub that one task aligns, on average at most.
PARTNERS = 2000

_FUNCTIONS = mix(np.arange(1, BANDS * PER_BAND + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_TOP = U(0xFFFFFFFFFFFFFFFF)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """k-mer hashes with their occurrence number mixed in: the second equal k-mer differs from the first."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    new = np.ones(len(kmers), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return kmers
    at = np.arange(len(kmers))
    times = np.empty(len(kmers), dtype=U)
    times[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(U)
    return mix(kmers + times * U(0x632BE59BD9B4E019))


def sketch(x: np.ndarray) -> np.ndarray:
    """Band keys of one document from its labelled k-mers.

    Each function orders all k-mers; the KEPT smallest are hashed in the order
    in which they stand in the text, so moved passages change a sketch while
    plain MinHash wouldn't see them.
    """
    n, functions = len(x), len(_FUNCTIONS)
    at = np.empty((functions, min(KEPT, n)), dtype=np.int64)
    step = max(1, (1 << 21) // n)
    for lo in range(0, functions, step):
        values = x[None, :] * _FUNCTIONS[lo : lo + step, None]
        rows = np.arange(len(values))
        for k in range(at.shape[1]):
            low = values.argmin(axis=1)
            at[lo : lo + step, k] = low
            values[rows, low] = _TOP
    at.sort(axis=1)
    key = _FUNCTIONS.copy()
    for k in range(at.shape[1]):
        key = mix(key * U(0xD6E8FEB86659FD93) + x[at[:, k]])
    band = key.reshape(BANDS, PER_BAND)
    out = np.arange(BANDS, dtype=U)
    for k in range(PER_BAND):
        out = mix(out * U(0x9E3779B97F4A7C15) + band[:, k])
    return out


def histograms(words: Words) -> np.ndarray:
    """Words of every document by hash cell, counted up to 255: documents x CELLS bytes."""
    n = np.diff(words.first)
    cell = np.repeat(np.arange(len(n)) * CELLS, n) + (mix(words.codes[words.first[0] : words.first[-1]]) % U(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=len(n) * CELLS), 255).astype(np.uint8).reshape(len(n), CELLS)


def folded(cells: np.ndarray) -> np.ndarray:
    """Histograms of FOLDED cells: sums of every FOLDED-th cell, up to 65535."""
    return np.minimum(cells.reshape(len(cells), -1, FOLDED).sum(axis=1, dtype=np.int64), 65535).astype(np.uint16)


def pair_edits(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``least_edits`` of row i of ``a`` and row j of ``b``, for lists of such pairs."""
    size, out = [x.sum(axis=1, dtype=np.int64) for x in (a, b)], np.empty(len(i), dtype=np.int64)
    for at in range(0, len(i), 4096):
        p, q = i[at : at + 4096], j[at : at + 4096]
        out[at : at + 4096] = np.maximum(size[0][p], size[1][q]) - np.minimum(a[p], b[q]).sum(axis=1, dtype=np.int64)
    return out


def least_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every row of ``a`` and of ``b``, edits that two texts of such histograms need at least.

    An edit takes away one word of a text at most, so each surplus word on one
    side costs one; equal words share a cell, and counts that end at 255 only
    lower the surplus.
    """
    left, right = a.T.astype(np.uint16), b.T.astype(np.uint16)
    common, part = np.zeros((len(a), len(b)), dtype=np.int64), np.empty((len(a), len(b)), dtype=np.uint16)
    for x, y in zip(left, right, strict=True):
        if x.any() and y.any():
            common += np.minimum(x[:, None], y[None, :], out=part)
    return np.maximum(left.sum(axis=0, dtype=np.int64)[:, None], right.sum(axis=0, dtype=np.int64)[None, :]) - common


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id and x (which name a text), digest (d1, d2) and number of its words, and band keys (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch["text"])
            for a, b in slices(at):
                words = words_of(data, at[a : b + 1])
                d1, d2 = sequence_digests(words)
                kmers = run_hashes(words.codes, SHINGLE, SEEDS[0])
                n, keys = np.diff(words.first), []
                for d in range(b - a):
                    lo, size = int(words.first[d]), int(n[d])
                    if size:  # a text shorter than a k-mer is one k-mer
                        keys.append(sketch(labelled(kmers[lo : lo + size - SHINGLE + 1]) if size >= SHINGLE else d1[d : d + 1]))
                ends = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
                flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["x"].slice(a, b - a), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "x", "d1", "d2", "n_words", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, x long, d1 long, d2 long, n_words long, bands array<long>")


def members(texts: DataFrame, pairs: DataFrame, crowded: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts that take part in a pair or stand in a crowded bucket: (node, text, n_words, bands, cells).

    All rounds read these, so the texts of all documents are shuffled once.
    Histograms are made for crowded buckets only; elsewhere they are null.
    """
    crowd = crowded.select("node").distinct().withColumn("crowd", F.lit(True))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(crowd, "node", "full")
    named = texts.select("node", F.col("rep").alias("doc_id"), "x", "n_words", "bands").join(needed, "node")
    # Neither side has a size bound, so both are shuffled at every size; AQE splits skewed parts.
    rows = named.hint("merge").join(docs, ["doc_id", "x"]).select("node", "text", "n_words", "bands", "crowd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch["text"])
            for a, b in slices(at):
                crowd = batch["crowd"].slice(a, b - a).to_pylist()
                cells = histograms(words_of(data, at[a : b + 1]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(a, b - a) for c in ("node", "text", "n_words", "bands")), pa.array([c.tobytes() if own else None for c, own in zip(cells, crowd, strict=True)], pa.binary())],
                    names=["node", "text", "n_words", "bands", "cells"],
                )

    return rows.mapInArrow(run, "node long, text string, n_words long, bands array<long>, cells binary")


def candidates(texts: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """First pairs a < b of (node, n_words, bands) rows that share a band key and have lengths that allow a link, and the crowded buckets.

    Buckets of up to SMALL rows give all pairs.  Larger ones have HUBS hubs,
    the smallest ids of hash groups, which differ from bucket to bucket; of all
    these a row is paired with the HUBS hubs with which it shares the most
    buckets.  Their other pairs are left to ``rest``, for which their rows are
    returned as (key, node).
    """
    posted = work.table(texts.select("node", "n_words", F.explode("bands").alias("key")), "posted")
    group = F.pmod(F.xxhash64("node", "key"), F.lit(HUBS))
    one = F.struct("node", "n_words")
    hubs = [F.min(F.when(group == h, one)) for h in range(HUBS)]
    buckets = work.table(posted.groupBy("key").agg(F.count("*").alias("n"), F.array(*hubs).alias("hubs")).where("n > 1"), "buckets")
    members = posted.join(buckets, "key")
    small = members.where(F.col("n").between(3, SMALL)).groupBy("key").agg(F.collect_list(one).alias("all"))
    by_two = members.where("n = 2").select(one.alias("x"), F.explode("hubs").alias("y"))
    by_pair = small.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    fits = F.least("x.n_words", "y.n_words") >= F.lit(LEAST) * F.greatest("x.n_words", "y.n_words") - 1e-9
    other = F.col("y").isNotNull() & (F.col("x.node") != F.col("y.node")) & fits
    shared = members.where(F.col("n") > SMALL).select(one.alias("x"), F.explode("hubs").alias("y")).where(other).groupBy("x", "y").agg(F.count("*").alias("n"))
    # A row has at most HUBS * BANDS hubs, so these groups are small.
    nearest = shared.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), "y"))), 1, HUBS).alias("best"))
    by_hub = nearest.select("x", F.explode("best").alias("best")).select("x", "best.y")
    pairs = by_hub.union(by_two.union(by_pair).where(other))
    out = work.table(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    crowded = work.table(members.where(F.col("n") > SMALL).select("key", "node"), "crowded")
    work.drop(posted, buckets)
    return out, crowded


def rest(texts: DataFrame, crowded: DataFrame, labels: DataFrame, done: DataFrame, work: Work, most: int, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b inside crowded buckets that are neither in one class nor among ``done`` and that histograms don't rule out; and the buckets that have more.

    A bucket of several classes is cut into blocks by a hash of the node, and
    every two blocks meet in a group of bounded size, so all pairs are looked
    at, whatever the size of the bucket.  A class of over BLOCK rows has blocks
    of its own, which don't meet each other: rows are copied in proportion to
    the class times what lies outside it, not to its square.  Where two blocks
    hold over ``most`` pairs of the same two classes, those with the fewest
    edits by their histograms come first; one link of them makes all others
    needless.  Such buckets (key) are all that a later round has to look at.
    """
    if keys is not None:
        crowded = crowded.join(keys, "key", "left_semi")
    own = work.table(crowded.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "node", F.coalesce("label", "node").alias("label")), "own")
    classes = work.table(own.groupBy("key", "label").agg(F.count("*").alias("c")).withColumn("pure", F.when(F.col("c") > BLOCK, F.ceil(F.col("c") / BLOCK)).otherwise(0)), "sizes")
    loose = F.ceil(F.sum(F.when(F.col("pure") == 0, F.col("c")).otherwise(0)) / BLOCK)
    split = classes.groupBy("key").agg(loose.alias("loose"), (loose + F.sum("pure")).alias("blocks"), F.count("*").alias("k")).where("k > 1").drop("k")
    # A bucket has few classes over BLOCK, so this window sees one row for BLOCK rows at most.
    earlier = Window.partitionBy("key").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    large = classes.where("pure > 0").select("key", "label", "pure", F.coalesce(F.sum("pure").over(earlier), F.lit(0)).alias("before"))
    rows = own.join(split, "key").join(large, ["key", "label"], "left").join(texts.select("node", "n_words", "cells", "bands"), "node")
    first, end = F.col("loose") + F.col("before"), F.col("loose") + F.col("before") + F.col("pure")
    rows = rows.withColumn("block", F.when(F.col("pure").isNull(), F.pmod(F.xxhash64("node"), F.col("loose"))).otherwise(first + F.pmod(F.xxhash64("node"), F.col("pure"))))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    rows = rows.withColumn("other", F.explode(F.when(F.col("pure").isNull(), every).otherwise(F.filter(every, lambda o: (o < first) | (o >= end)))))
    dealt = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "label", "n_words", "cells", "bands")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, label, n, block = (group[c].to_numpy() for c in ("node", "label", "n_words", "block"))
        cells = np.frombuffer(b"".join(group["cells"].to_pylist()), dtype=np.uint8).reshape(len(node), CELLS)
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        shorter, longer = np.minimum(n[x][:, None], n[y][None, :]), np.maximum(n[x][:, None], n[y][None, :])
        open_ = (label[x][:, None] != label[y][None, :]) & (shorter >= LEAST * longer - 1e-9)
        if lo == hi:
            open_ &= node[x][:, None] < node[y][None, :]
        most_edits = ((1 - LEAST) * longer + 1e-9).astype(np.int64)
        if open_.any():
            open_ &= least_edits(folded(cells[x]), folded(cells[y])) <= most_edits
        i, j = np.nonzero(open_)
        edits = pair_edits(cells[x], cells[y], i, j)
        near = edits <= most_edits[i, j]
        i, j, edits = i[near], j[near], edits[near]
        bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
        own = (bands[x[i]] == bands[y[j]]).argmax(axis=1) == int((bands[0] == group["key"][0].as_py()).argmax())
        i, j, edits = i[own], j[own], edits[own]  # other pairs meet in an earlier band
        p, q = label[x[i]], label[y[j]]
        p, q = np.minimum(p, q), np.maximum(p, q)
        order = np.lexsort((j, i, edits / longer[i, j], q, p))
        i, j, p, q = i[order], j[order], p[order], q[order]
        new = np.ones(len(i), dtype=bool)
        new[1:] = (np.diff(p) != 0) | (np.diff(q) != 0)
        at = np.arange(len(i))
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        i, j, nth = i[nth <= most], j[nth <= most], nth[nth <= most]
        kept = nth < most
        p, q = node[x[i[kept]]], node[y[j[kept]]]
        same = lambda c: pa.repeat(group[c][0], len(p))
        return pa.table({"key": same("key"), "a": np.minimum(p, q), "b": np.maximum(p, q), "more": np.full(len(p), not kept.all())})

    found = work.table(dealt.groupBy("key", "lo", "hi").applyInArrow(compare, "key long, a long, b long, more boolean"), "found")
    out = work.table(found.select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "rest")
    more = work.table(found.where("more").select("key").distinct(), "more")
    work.drop(own, classes, found)
    return out, more


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs whose alignment similarity, 1 - edit distance in words / longer length, is ``least`` or more: (a, b, similarity).

    ``texts`` has the (node, text) of every id in a pair.

    Both texts of a pair meet in a task that is picked by the smaller id and a
    hash of the other one, so a text with very many partners is spread out.
    """
    groups = max(32, pairs.count() // PARTNERS)
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(groups)).cast("int").alias("grp"))
    needed = dealt.select(F.col("b").alias("id"), "a", "grp").union(dealt.select(F.col("a").alias("id"), "a", "grp").distinct())
    # Neither side has a size bound, so both are shuffled at every size; AQE splits skewed parts.
    rows = needed.hint("merge").join(texts.select(F.col("node").alias("id"), "text"), "id").select("a", "grp", "id", "text")
    rows = rows.repartition("a", "grp").sortWithinPartitions("a", "grp", "id")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, words = None, []
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            for a, b, text in zip(batch["a"].to_pylist(), batch["id"].to_pylist(), batch["text"], strict=True):
                own = text.as_buffer().to_pybytes().split()
                if a == b:  # ids ascend, so a hub's own text comes first
                    hub, words = a, own
                elif hub == a and (s := similarity(words, own, least)) >= least:
                    found.append((a, b, s))
            if found:
                yield pa.RecordBatch.from_pydict({"a": [f[0] for f in found], "b": [f[1] for f in found], "similarity": [f[2] for f in found]})

    return rows.mapInArrow(align, "a long, b long, similarity double")


def nodes(copies: DataFrame, work: Work) -> tuple[DataFrame, bool]:
    """Texts that have an id, with a number each, ``node``; and whether some id has several.

    A node is the text's least id.  Where an id has several texts, one keeps
    it and the others get numbers above all ids.
    """
    texts = copies.where("rep IS NOT NULL")
    several = work.table(texts.groupBy("rep").agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2")).alias("least")).where("n > 1"), "several")
    if several.isEmpty():
        return texts.withColumn("node", F.col("rep")), False
    top, total = texts.agg(F.max("rep")).first()[0], several.agg(F.sum("n")).first()[0]
    own = F.col("least").isNull() | (F.col("least") == F.struct("d1", "d2"))
    more = with_class(texts, several, ["rep"], "n", total, "left").withColumn("node", F.when(own, F.col("rep")).otherwise(F.lit(top) + 1 + F.monotonically_increasing_id()))
    return work.table(more.drop("least", "n"), "nodes"), True


def near_duplicates(docs: DataFrame, work: Work, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The class of every document: (doc_id, x, copy_of, class_id); x is a hash of the text.

    ``copy_of`` is the smallest id with the same word sequence, ``class_id``
    the smallest id that links lead to.  Two different texts are linked if
    they share a band of Order MinHash sketches over five-word k-mers and
    align with similarity 0.8 or more.  Any two texts of one band are aligned
    unless links of others have put them into one class, or their lengths or
    words rule that similarity out: buckets of up to SMALL texts at once,
    larger ones through hubs first and then in rounds, each of which takes
    MORE times as many pairs of two classes, until none is left.

    Every row of ``docs`` has a row; rows of one id repeat, and several texts
    of one id are texts of their own.  A null text, an empty one and one of
    white space are a class of their own.  A null id has the class of its text,
    null if no id has that text.  Shorter texts than a k-mer are linked to equal
    word sequences only.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("x"), F.col(text).cast("string").alias("text"))
    found = work.table(sketches(rows), "sketches")
    one = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "x"))).alias("one")
    copies = found.where("n_words > 0").groupBy("d1", "d2").agg(one, *[F.first(c).alias(c) for c in ("n_words", "bands")])
    copies = work.table(copies.select("d1", "d2", F.col("one.doc_id").alias("rep"), "one.x", "n_words", "bands"), "texts")
    (texts, several), named = nodes(copies, work), rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    done, crowded = candidates(texts, work)
    taking = work.table(members(texts, done, crowded, named), "taking")
    links = work.table(verified(done, taking).select("a", "b").distinct(), "links")
    labels, most, keys = components(work, links), FIRST, None
    while keys is None or not keys.isEmpty():
        left, keys = rest(taking, crowded, labels, done, work, most, keys)
        if not left.isEmpty():
            new = work.table(verified(left, taking).select("a", "b").distinct(), "new")
            if not new.isEmpty():
                links = work.table(links.union(new), "links")
                labels = components(work, links)
            done = work.table(done.union(left), "done")
        most *= MORE
    classes = texts.select("d1", "d2", "rep", "node").join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("d1", "d2", "rep", F.coalesce("label", "node").alias("label"))
    if several:  # labels may be numbers above all ids
        classes = work.table(classes, "classes")
        least = classes.groupBy("label").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
        classes = with_class(classes, least, ["label"], "n", classes.count()).select("d1", "d2", "rep", F.col("least").alias("label"))
    own = F.col("n_words") == 0
    return found.join(classes, ["d1", "d2"], "left").select("doc_id", "x", F.when(own, F.col("doc_id")).otherwise(F.col("rep")).alias("copy_of"), F.when(own, F.col("doc_id")).otherwise(F.col("label")).alias("class_id"))
