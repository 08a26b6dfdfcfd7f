"""Token ids of whole texts, encoded word by word with a bounded cache."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from .wordhash import U, buffers, same_words, slices, words_of

#: Words kept by a worker (at most about 90 bytes each); a full cache starts anew.
CACHE_WORDS = 1_300_000
#: Words that one call of the library encodes as a single text.
JOINED = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Classes of bytes: 1 white space, 2 ASCII letters, 4 comma and full stop.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 2
_CLASS[[0x2C, 0x2E]] = 4


class Index:
    """An open-addressing hash table in arrays: from word codes to numbers 0, 1, ... of words."""

    def __init__(self, slots: int = 1 << 16):
        self.mask, self.used = slots - 1, 0
        self.keys, self.number = np.zeros(slots, dtype=U), np.zeros(slots, dtype=np.int32)

    def slots_of(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or of the empty place where its search ends."""
        slot = (keys & U(self.mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[slot[todo]]
            todo = todo[(there != keys[todo]) & (there != 0)]
            slot[todo] = (slot[todo] + 1) & self.mask
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        slot = self.slots_of(keys)
        return np.where(self.keys[slot] == keys, self.number[slot], -1).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        """Adds different keys that aren't there yet; they get the next numbers."""
        number = np.arange(self.used, self.used + len(keys), dtype=np.int32)
        used = self.used + len(keys)
        if 2 * used > self.mask:
            old = self.keys != 0
            keys, number = np.concatenate([self.keys[old], keys]), np.concatenate([self.number[old], number])
            self.__init__(1 << (3 * used).bit_length())
        self.used = used
        todo = np.arange(len(keys))
        while len(todo):  # of keys that meet in an empty slot the last one stays
            slot = self.slots_of(keys[todo])
            self.keys[slot] = keys[todo]
            mine = self.keys[slot] == keys[todo]
            self.number[slot[mine]] = number[todo[mine]]
            todo = todo[~mine]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1 << 12, dtype=kind), 0

    def add(self, new: np.ndarray) -> int:
        """Where the new values begin."""
        if self.n + len(new) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty(max(len(self.room) // 2, 2 * len(new)), dtype=self.room.dtype)])
        self.room[self.n : self.n + len(new)] = new
        self.n += len(new)
        return self.n - len(new)


def spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices starts[i], ..., starts[i] + lengths[i] - 1 for every i in turn."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class WordEncoder:
    """Token ids equal to those of encoding each whole text.

    Texts are cut at ASCII white space, and before a comma or full stop that
    ends a word after an ASCII letter; words are found by 64-bit hash in a
    hash table, and only new ones reach the library.  Every use of a word that
    is known already compares its bytes; a slice of texts in which two words
    share a hash is left to the library.  ASCII capitals are folded before.
    This is exact for tokenizers that lower-case, drop white
    space and keep letters apart from punctuation; a probe text decides on
    loading, and for others whole texts are encoded.
    """

    PROBE = "Ab c, d.e\tf\n'S x́y, 42 Été. ΣΣ\x0b\x0cQ.. W\r\n <|endoftext|>, <|endoftext|> z q,\n\n ok."

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = None
        if suffix:
            self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
            self.last[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        self._clear()
        self.whole = False
        self.whole = self.encode([self.PROBE])[0].tolist() != self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.index, self.flat, self.bytes = Index(), Grown(np.uint32), Grown(np.uint8)
        # By number of the word: first eight bytes, size, where the other bytes are, where ids are and how many.
        self.lane, self.size, self.rest, self.at, self.n = Grown(U), Grown(np.int32), Grown(np.int64), Grown(np.int64), Grown(np.int32)

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], dtype=np.uint32), np.array([len(ids) for ids in got], dtype=np.int64)

    def _direct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words of ASCII letters in lower case, which normalising and splitting leave as they are."""
        split = self.tokenizer.model.tokenize
        got = [[t.id for t in split(w)] for w in words]
        return np.array([i for ids in got for i in ids], dtype=np.uint32), np.array([len(ids) for ids in got], dtype=np.int64)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words of letters: many as one text, cut again at the marks of last pieces."""
        ids, n = [np.empty(0, dtype=np.uint32)], [np.empty(0, dtype=np.int64)]
        for at in range(0, len(words), JOINED):
            group = words[at : at + JOINED]
            own = np.array(self.tokenizer.encode(" ".join(group), add_special_tokens=False).ids, dtype=np.uint32)
            count = np.diff(np.flatnonzero(self.last[own]) + 1, prepend=0) if self.last is not None else own[:0]
            if len(count) != len(group) or count.sum() != len(own):
                own, count = self._library(group)
            ids.append(own)
            n.append(count)
        return np.concatenate(ids), np.concatenate(n)

    def _slice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        body, edges, edges_from = data[int(at[0]) : int(at[-1])], at - at[0], at[0]
        if not len(body):
            return np.empty(0, dtype=np.uint32), np.zeros(len(at), dtype=np.int64)
        if b"<|" not in body.tobytes():  # the names of special tokens keep their case
            body = _LOWER[body]
        kind = _CLASS[body]
        point = kind == 4
        point[:-1] &= kind[1:] == 1
        point[1:] &= kind[:-1] == 2
        point[0] = False
        words = words_of(body, edges, point, kind != 1)
        each, unique = pd.factorize(np.maximum(words.codes, U(1)))  # by hashing; sorting all words would cost more than all else here
        if self.index.used + len(unique) > CACHE_WORDS:
            self._clear()
        where = np.empty(len(unique), dtype=np.int64)
        where[each[::-1]] = np.arange(len(each) - 1, -1, -1)  # the first word of each kind is written last
        size, start = words.end - words.start, words.start
        kind = where[each]
        alike = (words.lane == words.lane[kind]) & (size == size[kind])
        long = np.flatnonzero(alike & (size > 8))
        alike[long] = same_words(body, start[long], body, start[kind[long]], size[long], 8)
        number = self.index.find(unique)
        old = np.flatnonzero(number >= 0)
        known, here = number[old], where[old]
        match = (self.lane.room[known] == words.lane[here]) & (self.size.room[known] == size[here])
        long = np.flatnonzero(match & (size[here] > 8))
        match[long] = same_words(self.bytes.room[: self.bytes.n], self.rest.room[known[long]] - 8, body, start[here[long]], size[here[long]], 8)
        if not (alike.all() and match.all()):
            raw, cut = data[int(edges_from) : int(edges_from) + len(body)].tobytes(), edges.tolist()
            ids, n = self._library([raw[a:b].decode() for a, b in zip(cut[:-1], cut[1:], strict=True)])
            return ids, np.concatenate([[0], np.cumsum(n)])
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            text = body.tobytes()
            first = where[fresh]
            new = [text[a:b].decode() for a, b in zip(start[first].tolist(), words.end[first].tolist(), strict=True)]
            kinds = np.array([0 if w.isalpha() and w.isascii() and w.islower() else 1 if w.isalpha() else 2 for w in new])
            order = np.argsort(kinds, kind="stable")
            ways = (self._direct, self._joined, self._library)
            parts = [way([new[i] for i in order[kinds[order] == k]]) for k, way in enumerate(ways)]
            ids, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            fresh, first = fresh[order], first[order]
            self.at.add(self.flat.add(ids) + np.cumsum(count) - count)
            self.n.add(count)
            self.lane.add(words.lane[first])
            self.size.add(size[first])
            more = np.maximum(size[first] - 8, 0)
            self.rest.add(self.bytes.add(body[spans(more, start[first] + 8)]) + np.cumsum(more) - more)
            number[fresh] = np.arange(self.index.used, self.index.used + len(fresh))
            self.index.add(unique[fresh])
        n = self.n.room[number].astype(np.int64)[each]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.flat.room[spans(n, self.at.room[number][each])], total[words.first]

    def encode_column(self, column: pa.Array, end: int | None = None):
        """For slices of a text column (null: empty): (first row, ids, offsets of each row's ids).

        ``end`` is appended to every row's ids if given.
        """
        if self.whole:
            ids, n = self._library([x or "" for x in column.to_pylist()])
            yield 0, *_ended(ids, np.concatenate([[0], np.cumsum(n)]), end)
            return
        data, at = buffers(column)
        for a, b in slices(at):
            yield a, *_ended(*self._slice(data, at[a : b + 1]), end)

    def encode(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        out = []
        for _, ids, at in self.encode_column(pa.array(texts, pa.large_string()), end):
            out += [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return out


def _ended(ids: np.ndarray, at: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end is None:
        return ids, at
    at = at.astype(np.int64)
    return np.insert(ids, at[1:], np.uint32(end)), at + np.arange(len(at))


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]
