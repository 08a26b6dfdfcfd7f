"""Token-id files: an adaptive context-mixing range coder in independent blocks.

Every id is coded under a mixture of three predictions.  Inside a block an
order-2 and an order-1 context each name the id that followed last time, with
a confidence; order 0 is the histogram of the segment, kept in its header.
How far each prediction is trusted adapts per block, in a context of both
confidences.  The mixture gives the id's interval in [0, 2**(MIX + bits)), and
a 64-bit carry-less range coder writes 32-bit words.

All blocks of a segment are coded side by side, one numpy lane for each, since
no block needs another one: contexts, trust and coder start anew, and each
block has its own CRC-32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work
from .tokens import encoder

MAGIC = b"LOOMIDS2"
#: Ids of a block, and blocks of a segment (the unit that is coded in one go; few lanes cost more for each id).
BLOCK, LANES = 2048, 4096
#: log2 of the total of the trust weights, and of the slots of the two context tables.
MIX, SLOTS1, SLOTS2 = 12, 9, 10
#: Trust moves by 2**-RATE of the way towards each outcome.
RATE = 5
#: The name of a file in its path.
NAME = "part-[0-9]+-[0-9]+[.]ids"
#: Steps whose contexts the encoder finds at once.
AHEAD = 16
U64, U32 = np.uint64, np.uint32
# Constants as arrays: an operation with a scalar takes longer to begin.
_WORD, _LOW = np.array(32, dtype=U64), np.array(0xFFFFFFFF, dtype=U64)
_1, _2, _3, _16, _FULL = (np.array(x, dtype=U32) for x in (1, 2, 3, 16, 0xFFFF))
_H1, _H2, _H3 = (np.array(x, dtype=U32) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
_TOPS, _HALVES = np.array([[32 - SLOTS1], [32 - SLOTS2]], dtype=U32), np.array([[0], [16]], dtype=U32)
_TOTAL, _SHARE2, _SHARE1 = (np.array((1 << MIX) - x, dtype=U32) for x in (0, 4, 2))
_RATE, _SIGN = np.array(RATE, dtype=np.int32), np.array(31, dtype=np.int32)


def order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Ids seen, their frequencies (at least 1 each, summing to 2**bits), bits, and the place of every id among those seen."""
    if ids.max() < 1 << 22:  # counting is much cheaper than sorting
        n = np.bincount(ids)
        seen = np.flatnonzero(n)
        place = np.zeros(len(n), dtype=np.int32)
        place[seen] = np.arange(len(seen))
        n, which = n[seen], place[ids]
    else:
        seen, which, n = np.unique(ids, return_inverse=True, return_counts=True)
    bits = max(16, int(len(seen) * 2 - 1).bit_length())
    if bits > 20:
        raise ValueError("too many distinct ids in a segment")
    scaled = 1 + (n * ((1 << bits) - len(seen)) // n.sum())
    scaled[scaled.argmax()] += (1 << bits) - scaled.sum()
    return seen.astype(U32), scaled.astype(U32), bits, which


def _mask(x: np.ndarray) -> np.ndarray:
    """All bits where ``x`` (below 2**31) is 0, else none."""
    return ((x - _1).view(np.int32) >> _SIGN).view(U32)


def _pick(mask: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """``yes`` where all bits of the mask are set, else ``no``; cheaper than np.where."""
    out = yes ^ no
    out &= mask
    out ^= no
    return out


class Model:
    """What both directions share: the contexts and trust of all lanes.

    A context slot holds a predicted id (below 2**30) and its confidence (two
    low bits).  ``trust`` estimates, in 16 bits each, how often order 2 is
    right (high half) and how often order 1 is where order 2 is not.  Arrays of
    two rows have order 1 in the first and order 2 in the second.  An operation
    takes about as long to begin as for a thousand lanes, so both orders share
    one; numbers are 32 bits wide wherever they fit, and bit masks choose.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=U32)
        self.base, self.of_trust = np.stack([lane << U32(SLOTS1), U32(lanes << SLOTS1) + (lane << U32(SLOTS2))]), lane << U32(5)
        self.slot = np.zeros(lanes * ((1 << SLOTS1) + (1 << SLOTS2)), dtype=U32)
        self.trust = np.full(lanes << 5, 1 << 29 | 1 << 13, dtype=U32)

    def slots(self, prev1: np.ndarray, prev2: np.ndarray) -> np.ndarray:
        """Where the contexts of the last id, and of the last two, are; for one step or several."""
        h = np.empty((*prev1.shape[:-1], 2, prev1.shape[-1]), dtype=U32)
        h1, h2 = h[..., 0, :], h[..., 1, :]
        np.multiply(prev1, _H1, out=h1)
        np.multiply(prev2, _H2, out=h2)
        h2 ^= h1
        h2 *= _H3
        h >>= _TOPS
        h += self.base
        return h.astype(np.intp)

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of 2**MIX for the ids that order 2 and order 1 predict (p[1], p[0]); the rest is order 0's."""
        self.at, self.entry = at, self.slot.take(at, mode="clip")
        self.p, self.sure = self.entry >> _2, self.entry & _3
        same = self.p[0] == self.p[1]
        ctx = self.sure[1] << _2
        ctx |= self.sure[0]
        ctx <<= _1
        ctx |= same
        ctx |= self.of_trust
        self.ctx = ctx.astype(np.intp)
        self.q = self.trust.take(self.ctx, mode="clip") >> _HALVES
        self.q &= _FULL
        w2 = self.q[1] * _SHARE2
        w2 >>= _16
        w2 += _1
        w1 = _SHARE1 - w2
        w1 *= self.q[0]
        w1 >>= _16
        w1 += _1
        w1 *= ~same
        return w2, w1

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """Learns the ids; the masks ``hit`` tell where they are p."""
        move = hit & _FULL
        move -= self.q
        way = move.view(np.int32)
        way >>= _RATE
        move[0] &= ~hit[1]
        self.q += move
        trust = self.q[1] << _16
        trust |= self.q[0]
        self.trust[self.ctx] = trust
        self.slot[self.at] = _pick(hit, self.entry + (self.sure < _3), _pick(_mask(self.sure), ids << _2, self.entry - _1))


def _renormalise(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Shifts a word out of intervals of at most 32 bits, in place; one that reaches into the next word is cut there."""
    word = low >> _WORD
    cross = (((low + span) >> _WORD) != word).nonzero()[0]
    if len(cross):
        span[cross] = np.negative(low[cross]) & _LOW
    low <<= _WORD
    span <<= _WORD
    return word.astype(U32)


def encode_blocks(blocks: np.ndarray, rank: np.ndarray, freq: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all lanes one after another, and how many each has; blocks is (BLOCK, lanes)."""
    steps, lanes = blocks.shape
    model, shift, one = Model(lanes), np.array(MIX + bits, dtype=U64), np.array(bits, dtype=U32)
    start0, certain = np.cumsum(freq, dtype=U32) - freq, np.array(1 << bits, dtype=U32)
    low, span = np.zeros(lanes, dtype=U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=U64)
    # Here all ids are known, so what doesn't depend on the model is found for AHEAD steps at once.
    before = np.zeros((2, lanes), dtype=U32)
    words, whose = [], []
    for t in range(steps):
        i = t % AHEAD
        if not i:
            before = np.concatenate([before[-2:], blocks[t : t + AHEAD]])
            slots = model.slots(before[1:-1], before[:-2])
            which = rank[t : t + AHEAD].astype(np.intp)
            starts, sizes = start0.take(which, mode="clip"), freq.take(which, mode="clip") - certain
        ids = blocks[t]
        w2, w1 = model.predict(slots[i])
        w0 = _TOTAL - w2
        w0 -= w1
        hit = _mask(ids ^ model.p)
        is1, is2 = hit
        not2, none = ~is2, ~(is2 | is1)
        at = w1 & none
        at += w2
        at &= not2
        at <<= one
        at += w0 * (starts[i] & none)
        size = _pick(is2, w2, _pick(is1, w1, w0))
        size *= (sizes[i] & none) + certain
        unit = span >> shift
        low += unit * at.astype(U64)
        span = unit
        span *= size.astype(U64)
        need = (span <= _LOW).nonzero()[0]
        if len(need):
            lo, sp = low[need], span[need]
            words.append(_renormalise(lo, sp))
            whose.append(need.astype(np.uint16))
            low[need], span[need] = lo, sp
        model.update(ids, hit)
    for part in (low >> _WORD, low & _LOW):
        words.append(part.astype(U32))
        whose.append(np.arange(lanes, dtype=np.uint16))
    who = np.concatenate(whose)
    return np.concatenate(words)[np.argsort(who, kind="stable")], np.bincount(who, minlength=lanes)


def decode_blocks(words: np.ndarray, first: np.ndarray, steps: int, seen: np.ndarray, freq: np.ndarray, bits: int) -> np.ndarray:
    """The ids (steps, lanes) of lanes whose words begin at ``first``."""
    lanes = len(first)
    model, shift, one = Model(lanes), np.array(MIX + bits, dtype=U64), np.array(bits, dtype=U32)
    start0 = np.cumsum(freq, dtype=U32) - freq
    owner = np.repeat(np.arange(len(seen), dtype=np.uint16 if len(seen) <= 1 << 16 else U32), freq)  # small, to stay in the cache
    top = np.array((1 << (MIX + bits)) - 1, dtype=U64)
    words = np.append(words, np.zeros(2, dtype=U32)).astype(U64)
    low, span = np.zeros(lanes, dtype=U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=U64)
    code, at_word = (words[first] << _WORD) | words[first + 1], first + 2
    out, prev1, prev2 = np.empty((steps, lanes), dtype=U32), np.zeros(lanes, dtype=U32), np.zeros(lanes, dtype=U32)
    for t in range(steps):
        w2, w1 = model.predict(model.slots(prev1, prev2))
        both = w2 + w1
        w0 = _TOTAL - both
        w2 <<= one
        w1 <<= one
        both <<= one
        unit = span >> shift
        value = code - low
        value //= unit
        value = np.minimum(value, top, out=value).astype(U32)
        in2 = value < w2
        not2 = in2.astype(U32)
        not2 -= _1
        is2 = ~not2
        ids, at, size = _pick(is2, model.p[1], model.p[0]), w2 & not2, _pick(is2, w2, w1)
        none = (value >= both).nonzero()[0]  # order 0's
        edge, own = both[none], w0[none]
        # Exact in double precision: both numbers are far below 2**53.
        which = owner.take(((value[none] - edge) / own).astype(np.intp), mode="clip").astype(np.intp)
        ids[none] = seen.take(which, mode="clip")
        at[none] = edge + own * start0.take(which, mode="clip")
        size[none] = own * freq.take(which, mode="clip")
        low += unit * at.astype(U64)
        span = unit
        span *= size.astype(U64)
        need = (span <= _LOW).nonzero()[0]
        if len(need):
            lo, sp = low[need], span[need]
            _renormalise(lo, sp)
            next_word = at_word[need]
            fresh = code[need]
            fresh <<= _WORD
            fresh |= words.take(next_word, mode="clip")
            next_word += 1
            code[need], at_word[need], low[need], span[need] = fresh, next_word, lo, sp
        model.update(ids, _mask(ids ^ model.p))
        out[t] = ids
        prev2, prev1 = prev1, ids
    return out


def _packed(values: np.ndarray) -> bytes:
    body = zlib.compress(np.ascontiguousarray(values).tobytes(), 6)
    return struct.pack("<I", len(body)) + body


def encode_segment(keys: np.ndarray, n_tokens: np.ndarray, ids: np.ndarray, null: np.ndarray | None = None) -> bytes:
    """One segment: keys (``null``: those that are null) and token counts of its documents, and their ids, at most BLOCK * LANES for one lane set."""
    n_blocks = -(-len(ids) // BLOCK)
    null = np.zeros(len(keys), dtype=bool) if null is None else null
    head = MAGIC + struct.pack("<QQII", len(keys), len(ids), BLOCK, n_blocks) + _packed(keys.astype("<i8")) + _packed(np.packbits(null)) + _packed(n_tokens.astype("<u4"))
    if not n_blocks:
        return head
    padded = np.full(n_blocks * BLOCK, ids[-1], dtype=U32)
    padded[: len(ids)] = ids
    seen, freq, bits, which = order0(padded)
    sides = lambda x: np.ascontiguousarray(x.reshape(n_blocks, BLOCK).T)
    words, n_words = encode_blocks(sides(padded), sides(which), freq, bits)
    plain = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    crc = np.array([zlib.crc32(plain[4 * BLOCK * i : 4 * BLOCK * (i + 1)]) for i in range(n_blocks)], dtype="<u4")
    table = struct.pack("<I", bits) + _packed(np.diff(seen, prepend=U32(0)).astype("<u4")) + _packed(freq.astype("<u4"))
    return head + table + _packed(n_words.astype("<u4")) + crc.tobytes() + words.astype("<u4").tobytes()


def decode_segment(body: bytes) -> tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]:
    """Keys (null ones masked), token counts and ids of a segment; a block that fails its checksum raises."""
    if body[:8] != MAGIC:
        raise ValueError("not a token-id segment")
    n_keys, n_ids, block, n_blocks = struct.unpack_from("<QQII", body, 8)
    at = 8 + struct.calcsize("<QQII")

    def packed(kind: str) -> np.ndarray:
        nonlocal at
        (n,) = struct.unpack_from("<I", body, at)
        at += 4 + n
        return np.frombuffer(zlib.decompress(body[at - n : at]), dtype=kind)

    keys, null, n_tokens = packed("<i8"), packed("u1"), packed("<u4").astype(np.int64)
    if len(keys) != n_keys:
        raise ValueError("broken header")
    keys = np.ma.array(keys, mask=np.unpackbits(null, count=len(keys)).astype(bool))
    if not n_blocks:
        return keys, n_tokens, np.empty(0, dtype=U32)
    (bits,) = struct.unpack_from("<I", body, at)
    at += 4
    seen, freq, n_words = np.cumsum(packed("<u4"), dtype=U32), packed("<u4"), packed("<u4").astype(np.int64)
    crc = np.frombuffer(body, dtype="<u4", count=n_blocks, offset=at)
    words = np.frombuffer(body, dtype="<u4", offset=at + 4 * n_blocks)
    ids = np.ascontiguousarray(decode_blocks(words, np.cumsum(n_words) - n_words, block, seen, freq, bits).T, dtype="<u4").ravel()[:n_ids]
    plain = ids.tobytes()
    for i in range(n_blocks):
        if zlib.crc32(plain[4 * block * i : 4 * block * (i + 1)]) != crc[i]:
            raise ValueError(f"block {i} fails its checksum")
    return keys, n_tokens, ids


def write_ids(docs: DataFrame, work: Work, tokenizer: str, end: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes every text into files of ids, in ascending key order: (file, part, seq, n_docs, n_ids) of each file.

    A file part-PPPPPP-SSSSSS.ids is one self-contained segment.  Tasks write
    them to a folder of their own in the shared folder, under another name
    first, which a rename completes; a task that runs again writes the same
    bytes over.  Segments are cut between documents once BLOCK * LANES ids are
    there; a longer document has a segment of its own, with as many lanes as it
    needs.  Null keys come first.  A null text has just the end id; repeated
    rows are all stored; an empty table gives no file; other columns are
    ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    folder = f"{work.root}/files"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        enc, part, seq = encoder(tokenizer), task.partitionId(), 0
        store, root = FileSystem.from_uri(folder)
        store.create_dir(root)
        keys, nulls, counts, held, n = [], [], [], [], 0

        def segment() -> pa.RecordBatch:
            own, per, ids = np.concatenate(keys), np.concatenate(counts), np.concatenate(held)
            name = f"part-{part:06d}-{seq:06d}.ids"
            with store.open_output_stream(f"{root}/_{name}-{task.taskAttemptId()}") as f:
                f.write(encode_segment(own, per, ids, np.concatenate(nulls)))
            store.move(f"{root}/_{name}-{task.taskAttemptId()}", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(own)], "n_ids": [len(ids)]})

        for batch in batches:
            null = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids_of = batch["doc_id"].fill_null(0).to_numpy()
            for first, ids, at in enc.encode_column(batch["text"], end):
                lo, rows = 0, len(at) - 1
                while lo < rows:
                    room = BLOCK * LANES - n
                    hi = int(np.searchsorted(at, at[lo] + room, side="right")) - 1
                    if hi <= lo and n:  # the next document begins a segment
                        yield segment()
                        seq, n = seq + 1, 0
                        keys, nulls, counts, held = [], [], [], []
                        continue
                    hi = max(lo + 1, hi)
                    keys.append(ids_of[first + lo : first + hi])
                    nulls.append(null[first + lo : first + hi])
                    counts.append(np.diff(at[lo : hi + 1]))
                    held.append(ids[at[lo] : at[hi]])
                    n, lo = n + int(at[hi] - at[lo]), hi
        if keys:
            yield segment()

    return work.table(rows.mapInArrow(encode, "file string, part int, seq int, n_docs long, n_ids long"), "ids")


def read_ids(files: DataFrame, ids: bool = False) -> DataFrame:
    """Reads files of ``write_ids`` and decodes them: doc_id, start, n_tokens, ids_crc32 (and ids) of each document.

    ``start`` counts the ids of all documents before, from the files' own
    counts: parts are summed first, then files inside a part.  No file gives an
    empty result.
    """
    spark = files.sparkSession
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", "part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before")).join(parts, "part")
    starts = starts.select(F.regexp_extract("file", NAME, 0).alias("name"), (F.col("before") + F.col("earlier")).alias("before"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    some = files.select("file").first()
    if not some:
        return spark.createDataFrame([], schema)
    bodies = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(some["file"].rpartition("/")[0])
    rows = bodies.select(F.regexp_extract("path", NAME, 0).alias("name"), F.col("content").alias("body")).join(starts, "name").select("body", "before")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, before in zip(batch["body"], batch["before"].to_pylist(), strict=True):
                keys, n, flat = decode_segment(body.as_py())
                at = np.concatenate([[0], np.cumsum(n)])
                plain = memoryview(flat.tobytes())
                crc = [zlib.crc32(plain[a:b]) for a, b in zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True)]
                columns = [pa.array(keys.data.astype(np.int64), mask=keys.mask), pa.array(before + at[:-1]), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(decode, schema)
