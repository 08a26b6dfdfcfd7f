"""Arrow UDFs for text steps that SQL functions can't express."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CONTAINED_SHARE, TITLE_SIMILARITY

# Tags of dropped subtrees, of main regions and of blocks; headings of skipped sections.
DROPPED = frozenset("script style nav header footer aside pre code svg button form noscript".split())
MAIN = frozenset("main article".split())
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li div section blockquote tr table ul ol br".split())
SKIPPED_SECTIONS = frozenset(("参考文献", "参考资料", "外部链接", "参见", "延伸阅读", "注释", "脚注", "references", "external links", "see also", "further reading", "notes", "bibliography", "sources"))
BLOCK_CHARS, CHUNK_CHARS, PICKED_BLOCKS = 6000, 3000, 3


def similarity(query: str, title: str) -> float:
    """1.0 if one contains the other and fills enough of it, else the Ratcliff-Obershelp ratio (query first)."""
    q, t = (x.lower().replace(" ", "") for x in (query or "", title or ""))
    if not q or not t:
        return 0.0
    if (q in t or t in q) and min(len(q), len(t)) >= CONTAINED_SHARE * max(len(q), len(t)):
        return 1.0
    return SequenceMatcher(None, q, t).ratio()


class _Reader(HTMLParser):
    """Collects text as (inside a main region, piece)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[bool, str]] = []
        self.open = {"drop": 0, "main": 0}
        self.has_main = False

    def _tag(self, tag: str, step: int) -> None:
        for kind, names in (("drop", DROPPED), ("main", MAIN)):
            if tag in names:
                self.open[kind] = max(0, self.open[kind] + step)
                self.has_main |= kind == "main" and step > 0
        if tag in BLOCKS:
            self.found.append((self.open["main"] > 0, "\n"))

    def handle_starttag(self, tag, attrs):
        self._tag(tag, 1)

    def handle_endtag(self, tag):
        self._tag(tag, -1)

    def handle_data(self, data):
        if not self.open["drop"]:
            self.found.append((self.open["main"] > 0, data))


def html_to_text(html: str | None) -> str:
    """Text of the main regions (of the page if it has none), a line for each block, single blank lines, no heading anchors."""
    reader = _Reader()
    reader.feed(html or "")
    body = "".join(piece for inside, piece in reader.found if inside or not reader.has_main).replace("¶", "")
    trimmed = "\n".join(line.strip() for line in body.splitlines())
    return re.sub(r"\n{3,}", "\n\n", trimmed).strip("\n")


def pack_pieces(pieces: list[str], limit: int, joint: str) -> list[str]:
    """Joins neighbours greedily while they fit into ``limit``."""
    out: list[str] = []
    for piece in pieces:
        if out and out[-1] and len(out[-1]) + len(joint) + len(piece) <= limit:
            out[-1] += joint + piece
        else:
            out.append(piece)
    return out


def chunks(text: str | None, limit: int) -> list[str]:
    """Paragraphs joined up to ``limit`` characters.

    Hard cuts of an overlong paragraph come out before the chunk that is being
    filled, and its rest goes on filling that chunk; callers rely on this order.
    """
    out, waiting = [], ""
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text or ""))):
        whole = (len(paragraph) - 1) // limit
        out += [paragraph[i * limit : (i + 1) * limit] for i in range(whole)]
        rest = paragraph[whole * limit :]
        joined = f"{waiting}\n\n{rest}" if waiting else rest
        if waiting and len(joined) > limit:
            out.append(waiting)
            joined = rest
        waiting = joined
    return out + [waiting] if waiting else out


def blocks(text: str | None, limit: int = BLOCK_CHARS) -> list[str]:
    """Sections (== heading ==) without reference-like ones, cut and joined up to ``limit`` characters."""
    lead, *rest = re.split(r"(?m)^\s*(={2,}\s*.+?\s*={2,})\s*$", text or "")
    units = [lead.strip()]
    for heading, body in zip(rest[::2], rest[1::2], strict=True):
        heading = heading.strip("= \t")
        if body.strip() and heading.lower() not in SKIPPED_SECTIONS:
            units.append(f"{heading}\n{body.strip()}")
    pieces = [p for unit in filter(None, units) for p in (chunks(unit, limit) if len(unit) > limit else [unit])]
    return pack_pieces(pieces, limit, "\n")


def json_in(text: str | None) -> str | None:
    """The first JSON value in a model's answer, fences and chatter removed; null if there is none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text or "", re.S)
    body = fenced[1] if fenced else text or ""
    start = re.search(r"[{\[]", body)
    if not start:
        return None
    try:
        value, _ = json.JSONDecoder(strict=False).raw_decode(body, start.start())
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False)


def _letters(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and character counts (folded into 64 classes) of texts, lower-case and without spaces."""
    plain = [(x or "").lower().replace(" ", "") for x in texts]
    return np.array([len(x) for x in plain]), np.array([np.bincount([ord(c) & 63 for c in x], minlength=64) if x else np.zeros(64, dtype=np.int64) for x in plain]).astype(np.int32)


def alike(query: pd.Series, title: pd.Series, least: float = TITLE_SIMILARITY) -> np.ndarray:
    """Whether ``similarity`` is ``least`` (0.75 or more) or higher.

    Two texts match in no more characters than they have in common, so shared
    characters bound the ratio, and a contained text that fills 0.6 of the
    other reaches 0.75 by this bound; only pairs within it are compared.
    """
    (qi, qs), (ti, ts) = pd.factorize(query, use_na_sentinel=False), pd.factorize(title, use_na_sentinel=False)
    if not len(qi):
        return np.zeros(0, dtype=bool)
    (ql, qc), (tl, tc) = (_letters([x if isinstance(x, str) else "" for x in u]) for u in (qs, ts))
    shared = np.minimum(qc[qi], tc[ti]).sum(axis=1)
    out = 2 * shared >= least * (ql[qi] + tl[ti]) - 1e-9
    for i in np.flatnonzero(out):
        out[i] = similarity(qs[qi[i]], ts[ti[i]]) >= least
    return out


class TitleMatcher:
    """Finds the names that titles are like: ``similarity`` of TITLE_SIMILARITY or more.

    Lengths rule most pairs out, then shared characters as in ``alike``.
    """

    def __init__(self, names: list[str]) -> None:
        self.names, self.sizes = names, [len(x.replace(" ", "")) for x in names]
        self.lengths, self.counts = _letters(names)

    def matches(self, titles: list[str]) -> Iterator[tuple[str, str]]:
        titles = sorted(titles, key=lambda t: len(t.replace(" ", "")))
        sizes = np.array([len(t.replace(" ", "")) for t in titles])
        lengths, counts = _letters(titles)
        for k, name in enumerate(self.names):
            # One size up and down for what is lost by rounding; the test proper follows.
            lo, hi = np.searchsorted(sizes, [0.59 * self.sizes[k] - 1, self.sizes[k] / 0.59 + 1])
            near = np.minimum(sizes[lo:hi], self.sizes[k]) >= 0.59 * np.maximum(sizes[lo:hi], self.sizes[k])
            shared = np.minimum(counts[lo:hi], self.counts[k]).sum(axis=1) if hi > lo else np.zeros(0)
            for i in np.flatnonzero(near & (2 * shared >= TITLE_SIMILARITY * (self.lengths[k] + lengths[lo:hi]) - 1e-9)) + lo:
                if similarity(name, titles[i]) >= TITLE_SIMILARITY:
                    yield name, titles[i]


@F.pandas_udf(T.DoubleType())
def similar(query: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([similarity(q, t) for q, t in zip(query, title, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(html_to_text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_blocks(text: pd.Series) -> pd.Series:
    return text.map(blocks)


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_chunks(text: pd.Series) -> pd.Series:
    return text.map(lambda x: chunks(x, CHUNK_CHARS))


@F.pandas_udf(T.StringType())
def first_json(text: pd.Series) -> pd.Series:
    return text.map(json_in)
