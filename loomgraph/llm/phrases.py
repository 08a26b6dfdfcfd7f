"""Substring dedup by repeated-phrase automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, with_class
from .wordhash import SEEDS, U, buffers, run_hashes, slices, sliding_min, words_of

#: Words of a window that counts as a repeat, and of the phrases that automata look for.
WINDOW, PHRASE = 50, 20
_SPAN = WINDOW - PHRASE + 1
#: Bytes of the documents that are streamed through the same automata, on average, and of those that share a partition if there are many.
GROUP_BYTES, PART_BYTES = 4 << 20, 256 << 20
#: Phrases of one automaton, at most, and automata that a worker holds; others are compiled for each batch of documents.
SHARD, HELD = 20_000, 3
#: log2 of the letters that one place of a word's spelling tells apart; nodes of an automaton search their branches one by one.
LETTER = 6
_TOP = U(0xFFFFFFFFFFFFFFFF)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def least_phrases(hashes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For every word, the least phrase hash of the window that starts there; 0 without a whole window."""
    least = sliding_min(hashes, _SPAN)
    return np.where(room[: len(least)] >= WINDOW, least, U(0))


def anchors(codes: np.ndarray, room: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, hashes and first places of their anchor phrases, distinct and ordered by document.

    In every whole window the phrase of least hash is an anchor.  Equal windows
    pick equal phrases, so a repeated window always shares an anchor.
    """
    hashes = run_hashes(codes, PHRASE, SEEDS[1])
    least = least_phrases(hashes, room)
    around = np.zeros(_SPAN - 1, dtype=U)
    at = np.flatnonzero((sliding_min(np.concatenate([around, least, around]), _SPAN, np.maximum) == hashes) & (hashes > 0)) if len(least) else np.empty(0, dtype=np.int64)
    doc, found = whose[at], hashes[at]
    order = np.lexsort((at, found, doc))
    doc, found, at = doc[order], found[order], at[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[new], found[new], at[new]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and x (which name a text), digest of the words (d1, d2, sha: of the words joined by spaces), n_words, n_bytes, anchors and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch["text"])
            for a, b in slices(at):
                words = words_of(data, at[a : b + 1])
                doc, found, where = anchors(words.codes, words.room(), words.doc_of())
                ends = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                body = data[at[a] : at[b]].tobytes()
                cut = (at[a : b + 1] - at[a]).tolist()
                sha = [hashlib.sha256(b" ".join(body[x:y].split())) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                halves = np.frombuffer(b"".join(x.digest()[:16] for x in sha), dtype="<i8").reshape(-1, 2)
                places = (where - words.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, b - a), batch["x"].slice(a, b - a), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.diff(words.first)), pa.array(np.diff(at[a : b + 1])),
                        pa.array([x.hexdigest() for x in sha]), pa.ListArray.from_arrays(ends, pa.array(found.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(places)),
                    ],
                    names=["doc_id", "x", "d1", "d2", "n_words", "n_bytes", "sha", "anchors", "places"],
                )

    return docs.mapInArrow(run, "doc_id long, x long, d1 long, d2 long, n_words long, n_bytes long, sha string, anchors array<long>, places array<int>")


def passages(homes: DataFrame) -> DataFrame:
    """(anchor, phrase) of rows (text, found): the words of each confirmed phrase, joined by spaces, from the document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, found in zip(batch["text"], batch["found"].to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                yield pa.RecordBatch.from_pydict({"anchor": [f["anchor"] for f in found], "phrase": [b" ".join(words[f["place"] : f["place"] + PHRASE]) for f in found]})

    return homes.mapInArrow(run, "anchor long, phrase binary")


class Shard:
    """An Aho-Corasick automaton of phrases, over letters that spell their words.

    The distinct words of the phrases are numbered, and a number is spelled
    with a fixed count of letters; each place has letters of its own, so a
    phrase is only found where a word begins.  All other words are spelled
    with letter 0.
    """

    def __init__(self, phrases: list[bytes]):
        import ahocorasick

        column = pa.array(phrases, pa.binary()).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        words = words_of(np.frombuffer(data, dtype=np.uint8), np.frombuffer(offsets, dtype=np.int64)[: len(phrases) + 1])
        self.known = np.unique(words.codes)
        self.places = -(-int(len(self.known)).bit_length() // LETTER)
        text = self.spelled(words.codes)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for i in (words.first[:-1] * self.places).tolist():
            self.found.add_word(text[i : i + PHRASE * self.places])
        self.found.make_automaton()

    def spelled(self, codes: np.ndarray) -> str:
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        number = np.where(self.known[at] == codes, at, -1)[:, None]
        places = np.arange(self.places)
        letters = np.where(number < 0, 0, 1 + (places << LETTER) + (number >> (LETTER * places) & ((1 << LETTER) - 1)))
        return letters.astype("<u4").tobytes().decode("utf-32-le")

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Where phrases begin in a sequence of words."""
        ends = np.fromiter((end for end, _ in self.found.iter(self.spelled(codes))), dtype=np.int64)
        return (ends + 1) // self.places - PHRASE


def _repeats_of(batch: pa.RecordBatch, shards: list[Shard | list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Windows of the documents of a batch (doc_id, x, text) that hold a phrase of the shards as their least one."""
    data, at = buffers(batch["text"])
    parts = [(a, b, words_of(data, at[a : b + 1])) for a, b in slices(at, 4 << 20)]
    marks = [np.zeros(len(words.codes), dtype=bool) for _, _, words in parts]
    for shard in shards:
        own = shard if isinstance(shard, Shard) else Shard(shard)
        for (_, _, words), held in zip(parts, marks, strict=True):
            held[own.starts(words.codes)] = True
    for (a, b, words), held in zip(parts, marks, strict=True):
        room = words.room()
        held &= room >= PHRASE  # others run into the next document
        if not held.any():
            continue
        hashes = run_hashes(words.codes, PHRASE, SEEDS[1])
        least = least_phrases(hashes, room)
        confirmed = sliding_min(np.where(held[: len(hashes)], hashes, _TOP), _SPAN)
        starts = np.flatnonzero((confirmed == least) & (least > 0))
        if not len(starts):
            continue
        h1, h2 = (run_hashes(words.codes, WINDOW, seed)[starts].view(np.int64) for seed in SEEDS)
        doc = words.doc_of()[starts]
        short, place = (h2 >> 32).astype(np.int32), (starts - words.first[doc]).astype(np.int32)
        order = np.lexsort((place, short, h1, doc))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(doc[order]) != 0) | (np.diff(h1[order]) != 0) | (np.diff(short[order]) != 0)
        first = place[order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]]
        some = lambda x, kind: pa.array(x[order], kind, mask=~new)
        row = pa.array(a + doc[order])
        columns = [some(h1, pa.int64()), some(short, pa.int32()), batch["doc_id"].take(row), batch["x"].take(row), pa.array(place[order]), pa.array(first, pa.int32(), mask=new)]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(order), pa.string())], names=["h1", "h2", "doc_id", "x", "place", "again", "text"])
        kept = pa.array(a + np.unique(doc))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.int32()), batch["doc_id"].take(kept), batch["x"].take(kept), pa.nulls(len(kept), pa.int32()), pa.nulls(len(kept), pa.int32()), batch["text"].take(kept).cast(pa.string())],
            names=["h1", "h2", "doc_id", "x", "place", "again", "text"],
        )


def located(rows: DataFrame) -> DataFrame:
    """Streams documents through automata: (h1, h2, doc_id, x, place, again, text).

    ``rows`` is (grp, kind, doc_id, x, text, phrase), ordered in its partitions
    by grp and kind.  Of each group come first the texts to look at (kind 0:
    doc_id, x), then its confirmed phrases (kind 1), which are compiled into
    automata of SHARD phrases at most, then documents (kind 2).  Each document
    is streamed through all automata of its group; where phrases stand is known
    from that alone.  A window is sent if its least phrase was found: equal
    windows have equal least phrases.  A window that its document had before
    has the place of the first one in ``again`` and no hashes, so a text that
    repeats a few words sends each window once.  Documents with such windows
    follow once more with their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, wanted, phrases, shards = None, set(), [], []
        for batch in batches:
            grp, kind = batch["grp"].to_numpy(), batch["kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(grp) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if grp[lo] != group:
                    group, wanted, phrases, shards = grp[lo], set(), [], []
                if kind[lo] == 1:
                    phrases += part["phrase"].to_pylist()
                    continue
                keys = list(zip(part["doc_id"].to_pylist(), part["x"].to_pylist(), strict=True))
                if kind[lo] == 0:
                    wanted.update(keys)
                    continue
                if phrases:
                    shards = [phrases[i : i + SHARD] for i in range(0, len(phrases), SHARD)]
                    shards, phrases = [Shard(x) for x in shards[:HELD]] + shards[HELD:], []
                mine = []
                for i, key in enumerate(keys):
                    if key in wanted:  # repeated rows are looked at once
                        wanted.remove(key)
                        mine.append(i)
                if mine and shards:
                    yield from _repeats_of(part.take(pa.array(mine)), shards)

    return rows.mapInArrow(run, "h1 long, h2 int, doc_id long, x long, place int, again int, text string")


def cut(texts: DataFrame) -> DataFrame:
    """Removed word spans and the digest of what is left: (doc_id, x, n_removed, kept_sha256, spans).

    ``texts`` is (doc_id, x, text, starts) with the first words of windows to remove.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, x, text, starts in zip(batch["doc_id"].to_pylist(), batch["x"].to_pylist(), batch["text"], batch["starts"], strict=True):
                words = text.as_buffer().to_pybytes().split()
                at = np.sort(starts.values.to_numpy())
                new = np.flatnonzero(np.diff(at, prepend=-WINDOW - 1) > WINDOW)
                spans = list(zip(at[new].tolist(), (at[np.append(new[1:] - 1, len(at) - 1)] + WINDOW).tolist(), strict=True))
                kept, last = [], 0
                for lo, hi in spans:
                    kept += words[last:lo]
                    last = hi
                kept += words[last:]
                rows.append({"doc_id": doc, "x": x, "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(), "spans": [{"start": a, "stop": b} for a, b in spans]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("x", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPANS)]))

    return texts.mapInArrow(run, "doc_id long, x long, n_removed long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def phrase_dedup(docs: DataFrame, work: Work, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Words that windows seen in an earlier document cover: (doc_id, n_words, n_removed, kept_sha256, spans).

    A window is WINDOW consecutive words of one document; its words go if the
    same sequence starts in a document with a smaller id.  Steps: texts with
    the same words are reduced to the one with the smallest id; anchor phrases
    of several texts are confirmed, and their words fetched from one text each;
    every text with a whole window is streamed through automata that hold all
    confirmed phrases that its group of texts may have; windows around the
    phrases found are compared by 96-bit hash, and those whose first document
    is an earlier one go.  Hashes are grouped with partial aggregation, and
    classes with a large share of all rows are joined by broadcast, so a
    passage that a third of all documents hold meets in no single task.  Each
    step's shuffle files go when its table is written, so no two steps' are on disk at once.

    A null text has no words.  Rows with a null id neither lose words nor cause
    a loss.  Repeated rows of one id are judged alike, and several texts of one
    id never against each other.  Texts under WINDOW words keep all; a text is
    never cut, however long.  An empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("x"), F.col(text).cast("string").alias("text"))
    base = work.table(described(rows), "described", free=True)
    named = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    long = base.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    texts = long.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "x")).alias("rep"), F.first("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors"), F.first("places").alias("places"))
    texts = work.table(texts.select("d1", "d2", "rep.*", "n_bytes", "anchors", "places"), "texts", free=True)
    size = texts.agg(F.sum("n_bytes")).first()[0] or 0
    groups = max(1, size // GROUP_BYTES)
    parts = min(groups, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES))
    grp = F.pmod(F.xxhash64("doc_id", "x"), F.lit(groups)).cast("int")
    posted = texts.select("doc_id", "x", F.explode(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("places").alias("place"))).alias("p")).select("doc_id", "x", "p.*")
    homes = posted.groupBy("anchor").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "x", "place")]).where("n > 1")
    homes = homes.groupBy("doc_id", "x").agg(F.collect_list(F.struct("anchor", "place")).alias("found"))
    confirmed = work.table(passages(named.join(homes, ["doc_id", "x"]).select("text", "found")).dropDuplicates(["anchor"]), "confirmed", free=True)
    needed = posted.select(grp.alias("grp"), "anchor").distinct().join(confirmed, "anchor")
    columns = {"grp": "int", "kind": "int", "doc_id": "long", "x": "long", "text": "string", "phrase": "binary"}
    part = lambda df, kind: df.withColumn("kind", F.lit(kind)).select(*[(F.col(c) if c in (*df.columns, "kind") else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    streams = part(texts.withColumn("grp", grp).select("grp", "doc_id", "x"), 0).union(part(needed, 1)).union(part(named.withColumn("grp", grp), 2))
    found = work.table(located(streams.repartition(parts, "grp").sortWithinPartitions("grp", "kind")), "located", free=True)
    once, again = found.where("h1 IS NOT NULL").select("h1", "h2", "doc_id", "x", "place"), found.where("again IS NOT NULL").select("doc_id", "x", F.col("place").alias("repeat"), F.col("again").alias("place"))
    earliest = work.table(once.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("h1", "h2", "first", "n"), "earliest", free=True)
    total = earliest.agg(F.sum("n")).first()[0] or 0
    later = work.table(with_class(once, earliest, ["h1", "h2"], "n", total).where(F.col("doc_id") > F.col("first")).select("doc_id", "x", "place"), "later", free=True)
    repeats = again.join(later, ["doc_id", "x", "place"]).select("doc_id", "x", F.col("repeat").alias("place"))
    starts = later.union(repeats).groupBy("doc_id", "x").agg(F.collect_set("place").alias("starts"))
    flagged = work.table(cut(found.where("text IS NOT NULL").select("doc_id", "x", "text").join(starts, ["doc_id", "x"])), "cut", free=True)
    work.drop(found, confirmed, earliest, later)
    copy = (F.col("n_words") >= WINDOW) & (F.col("rep") < F.col("doc_id"))
    # Texts of the same words differ in x where their white space does, so the answer goes by the words' digest.
    reps = texts.select("d1", "d2", F.col("doc_id").alias("rep"), "x").join(flagged.withColumnRenamed("doc_id", "rep"), ["rep", "x"], "left").drop("x")
    out = base.join(reps, ["d1", "d2"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    own = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce(F.when(own, F.col("n_removed")), F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.when(own, F.col("kept_sha256")), F.col("sha"))).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce(F.when(own, F.col("spans")), none)).alias("spans"),
    )


def sql() -> str:
    """The same removal by grouping all windows, for DuckDB."""
    return rf"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT doc_id, i AS pos, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
f AS (
  SELECT h, min(doc_id) AS first FROM g GROUP BY h),
c AS (
  SELECT DISTINCT g.doc_id, g.pos + k AS pos FROM g JOIN f USING (h), range({WINDOW}) t(k) WHERE f.first < g.doc_id),
e AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
k AS (
  SELECT e.doc_id, count(c.pos) AS n_removed, string_agg(CASE WHEN c.pos IS NULL THEN word END, ' ' ORDER BY e.pos) AS kept
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""
