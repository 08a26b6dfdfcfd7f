"""Vectorised hashing of words and word runs over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the
pattern ``[^\\x20\\x09-\\x0D]+`` on the decoded text, because those six
separators are single bytes in UTF-8.  Every function works on a whole slice
of documents at once; nothing loops over words in Python, but for words over
LONG bytes.

A word's code chains its bytes, eight at a time, through a 64-bit mixer, so no
family of inputs cancels out as it can in a polynomial modulo a power of two.
Codes of runs of words join codes of halves by the same mixer.  Equality that
must hold for certain is decided on bytes (``same_words``) or by BLAKE2b
(``sequence_digests``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Words over so many bytes are hashed by BLAKE2b, one by one.
LONG = 256
#: Seeds of independent hashes of word runs.
SEEDS = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_JOIN, _LENGTH = U(0x9E3779B97F4A7C15), U(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply, three rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def run_hashes(codes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of codes[i:i+k] for every i with a whole run, ignoring documents.

    Hashes of 1, 2, 4, ... words are doubled; those of the powers of two that
    make up ``k`` are joined in order.
    """
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    level, span, out, at = mix(codes ^ U(seed)), 1, None, 0
    while True:
        if k & span:
            part = level[at : at + n]
            out, at = part if out is None else mix(out * _JOIN + part), at + span
        span *= 2
        if span > k:
            return out
        level = mix(level[: -span // 2] * _JOIN + level[span // 2 :])


@dataclass
class Words:
    """The words of some documents: document d owns words[first[d]:first[d+1]].

    ``start`` and ``end`` are byte offsets into ``data``; ``lane`` has the first
    eight bytes of each word as a number.
    """

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    lane: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def room(self) -> np.ndarray:
        """For every word, the number of words of its document from it on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.codes))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8), at


def words_of(data: np.ndarray, at: np.ndarray, cut: np.ndarray | None = None, inside: np.ndarray | None = None) -> Words:
    """Split and hash the documents data[at[d]:at[d+1]]; ``cut`` marks bytes that start a word in any case, ``inside`` those of words if that is known."""
    base = int(at[0])
    body = data[base : int(at[-1])]
    edges = at - base
    n = len(body)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return Words(np.empty(0, dtype=U), none, none, np.zeros(len(at), dtype=np.int64), body, np.empty(0, dtype=U))
    inside = ~_SEP[body] if inside is None else inside
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = edges[(edges > 0) & (edges < n)]
    before[cuts] = False
    if cut is not None:
        before &= ~cut
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    if cut is not None:
        after[:-1] &= ~cut[1:]
    end = np.flatnonzero(inside & ~after) + 1
    codes, lane = word_codes(body, start, end)
    return Words(codes, start, end, np.searchsorted(start, edges), body, lane)


def eights(body: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``body`` on, as little-endian numbers; zeros follow the end."""
    padded = np.concatenate([body, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(body),), dtype="<u8", buffer=padded, strides=(1,))


def _lane(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from ``at``, of which ``left`` belong to the word."""
    return view[at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(8) * (8 - np.minimum(left, 8)).astype(U)))


def word_codes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of words, and their first eight bytes."""
    view, size = eights(body), end - start
    first = _lane(view, start, size)
    codes = mix(first + size.astype(U) * _LENGTH)
    todo, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(todo):
        codes[todo] = mix(codes[todo] * _JOIN + _lane(view, start[todo] + at, size[todo] - at))
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        codes[i] = U(int.from_bytes(hashlib.blake2b(body[start[i] : end[i]], digest_size=8).digest(), "little"))
    return codes, first


def same_words(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray, done: int = 0) -> np.ndarray:
    """Whether size[i] bytes at at_a[i] of ``a`` and at at_b[i] of ``b`` are the same; the first ``done`` are taken to be."""
    same = np.ones(len(size), dtype=bool)
    todo = np.flatnonzero(size > done)
    if len(todo):
        left, right = eights(a), eights(b)
    while len(todo):
        own = _lane(left, at_a[todo] + done, size[todo] - done) == _lane(right, at_b[todo] + done, size[todo] - done)
        same[todo[~own]] = False
        done += 8
        todo = todo[own & (size[todo] > done)]
        if done > LONG:
            for i in todo.tolist():
                same[i] = a[at_a[i] + done : at_a[i] + size[i]].tobytes() == b[at_b[i] + done : at_b[i] + size[i]].tobytes()
            break
    return same


def sequence_digests(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of every document's words joined by spaces, as two 64-bit numbers."""
    body = words.data.tobytes()
    n = np.diff(words.first)
    lo, hi = words.start[words.first[:-1][n > 0]], words.end[words.first[1:][n > 0] - 1]
    out = np.zeros((len(n), 2), dtype=U)
    some = [hashlib.blake2b(b" ".join(body[a:b].split()), digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    out[n > 0] = np.frombuffer(b"".join(some), dtype="<u8").reshape(-1, 2)
    return np.ascontiguousarray(out[:, 0]), np.ascontiguousarray(out[:, 1])


def slices(at: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; one document is never cut."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def sliding_min(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over x[i:i+w] for every whole window, by doubling."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    out = x
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[:n], out[w - span : w - span + n]) if span < w else out[:n]
