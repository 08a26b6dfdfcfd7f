"""Column expressions over names, titles, sources and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space; Java's plain \s knows ASCII only.
SPACE = r"(?U)\s"
#: What words are made of, and the gaps between them.
WORD, GAP = r"[\pL\pN_]", r"[^\pL\pN_]+"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def norm(s: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(s, SPACE, ""))


def key(s: Column) -> Column:
    """What names and titles are compared by."""
    return F.lower(strip(s))


def title_core(title: Column) -> Column:
    """A section title without its leading number."""
    return strip(F.regexp_replace(title, r"(?U)^[0-9.．\s]+", ""))


def without_tags(rationale: Column) -> Column:
    """A rationale without leading [tags]."""
    return F.regexp_replace(rationale, r"(?U)^(\[[^\]]{1,12}\]\s*)+", "")


def page_source(lang: Column, title: Column, revision: Column) -> Column:
    return F.concat(F.lit("wiki:"), lang, F.lit(":"), title, F.lit("@"), revision.cast("string"))


def page_url(lang: Column, title: Column) -> Column:
    return F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def section_prefix(book: Column, sec: Column) -> Column:
    return F.concat(F.lit("doc:"), book, F.lit(":"), sec)


def section_source(book: Column, sec: Column, content_hash: Column) -> Column:
    return F.concat(section_prefix(book, sec), F.lit("@"), content_hash)


def section_url(url: Column, book: Column, sec: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(section_prefix(book, sec))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def parse_section_source(source: Column) -> Column:
    """struct(book, sec_id, hash) of a section source; null for anything else."""
    pattern = r"^doc:([a-z0-9-]+):([^@]+)@([0-9a-f]{8,})$"
    part = lambda i, name: F.regexp_extract(source, pattern, i).alias(name)
    return F.when(source.rlike(pattern), F.struct(part(1, "book"), part(2, "sec_id"), part(3, "hash")))


def parse_page_source(source: Column) -> Column:
    pattern = r"^wiki:(zh|en):(.+)@\d+$"
    return F.when(source.rlike(pattern), F.struct(F.regexp_extract(source, pattern, 1).alias("lang"), F.regexp_extract(source, pattern, 2).alias("title")))


def evidence_parts(evidence: Column) -> Column:
    """The normalised, non-empty passages of a quotation between its ellipses."""
    cut = F.split(F.coalesce(evidence, F.lit("")), r"…|\.\.\.|。。。")
    return F.filter(F.transform(cut, norm), lambda p: p != "")


def evidence_in_text(evidence: Column, text: Column) -> Column:
    """Whether every passage of a quotation stands in the text, in any order; an empty quotation does not."""
    parts, body = evidence_parts(evidence), norm(F.coalesce(text, F.lit("")))
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(body, p))


def name_in_text(name: Column, text: Column, least: int = 3) -> Column:
    """Whether a name of at least ``least`` characters stands in the text: an ASCII name as whole words, others anywhere.

    Whole means that no letter, digit or underscore touches it, so a name may begin or end with a mark ("c++").
    """
    quoted = F.concat(F.lit(rf"(?<!{WORD})\Q"), F.replace(F.lower(name), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(rf"\E(?!{WORD})"))
    words = F.rlike(F.lower(text), quoted)
    return (F.length(name) >= least) & F.when(name.rlike(r"^[\x00-\x7f]+$"), words).otherwise(F.contains(norm(text), norm(name)))


def excerpt(text: Column, evidence: Column, around: int = 500) -> Column:
    """The text around a quotation (found by its first 20 characters), or its first 2 * ``around`` characters."""
    probe = strip(without_tags(F.coalesce(evidence, F.lit(""))))
    at = F.when(probe != "", F.instr(text, F.substring(probe, 1, 20))).otherwise(0)
    start = F.greatest(F.lit(1), at - around)
    near = F.substring(text, start, at + F.length(probe) + around - start)
    return F.when(at > 0, near).otherwise(F.substring(text, 1, 2 * around))


def occurrences(text: Column, word: Column) -> Column:
    """How often ``word`` occurs in ``text`` without overlap; 0 for an empty word."""
    shorter = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return F.when(F.length(word) > 0, (shorter / F.length(word)).cast("int")).otherwise(0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
