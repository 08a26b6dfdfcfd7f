"""Licence scans by canonical digest lookup (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import EQUIVALENT, KNOWN

#: Words that follow "copyright", or "(c)" as a list mark, in the prose of licences; other words there are names.
_PROSE = "(holders?|owners?)(?! *:)|(notices?|laws?|licen[sc]es?|statements?|and|or|in|is|are|of|on|to|that|interests?|protection|acts?|treat(y|ies)|under|infringement|management|status|disclaimers?)"
_LISTED = "you|your|accompany|any|if|the|an?|in|for|to|this|that|use|all|each|it|must|may|no|neither|redistributions?|copyright (holders?|owners?|notices?)"
#: A line of copyright (with a year, mark or name) or rights reservation, on lower-case text, with its line break.
COPYRIGHT_LINE = (
    r"(^|\n)[^\p{L}\p{N}©(\n]*(\((?!c\))[^\p{L}\p{N}©(\n]*)*"
    rf"(copyright([^\p{{L}}\p{{N}}\n]*(©|\(c\))|[^\p{{L}}\p{{N}}\n]+(?!({_PROSE})(?![\p{{L}}\p{{N}}]))[\p{{L}}\p{{N}}])"
    rf"|©|\(c\)[^\p{{L}}\p{{N}}\n]*(?!({_LISTED})(?![\p{{L}}\p{{N}}]))[\p{{L}}\p{{N}}]|all rights reserved)[^\n]*"
)
#: The SQL's pattern: it takes any line that begins with these words for a copyright line.
SQL_COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: ASCII other than lower-case letters and digits, and common typographic marks.
_MARKS = r"\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{ab}\x{bb}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{3000}"
PUNCTUATION = f"[{_MARKS}]+"
#: Digest tables up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words apart by one space, one spelling of equivalents."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, PUNCTUATION, " ")), F.lit(" "))
    # With two spaces in each gap, neighbours share none, so all of them are replaced.
    out = F.replace(out, F.lit(" "), F.lit("  "))
    for found, written in _spaced():
        out = F.replace(out, F.lit(found), F.lit(written))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _spaced() -> list[tuple[str, str]]:
    return [tuple(f" {x.replace(' ', '  ')} " for x in pair) for pair in EQUIVALENT]


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), f"[^{_MARKS}]+", 0)


def opening_words(table: DataFrame) -> DataFrame:
    """Every raw word that a text of ``table`` may open with, equivalent spellings included."""
    heads = table.select(F.substring_index("canonical", " ", 1).alias("head")).distinct()
    pairs = table.sparkSession.createDataFrame([(a.split()[0], b.split()[0]) for a, b in EQUIVALENT], "other string, head string")
    return heads.union(heads.join(pairs, "head").select("other")).distinct()


def scan(docs: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Looks up whole texts, and every line as a text of its own, among known licences.

    ``known`` is (license_id, text); ids that share a digest are joined by
    commas.  Returns doc_id, digest, license (of the whole text, null if
    unknown) and notices (sorted distinct ids of lines that are a known text on
    their own, joined by commas, null if none).

    A text without a word has the digest of the empty string, which matches no
    licence, and so do null texts; a null key keeps its whole-text answer but
    has no notices; repeated rows each get an answer; an empty table gives an
    empty result; other columns are ignored.  No text is shuffled: a line is
    digested where it is read, if it opens with a word that some known text
    opens with (no other line can be equal to one), and only hits travel.  Very
    long texts are read whole, line by line.
    """
    empty = F.sha2(F.lit(""), 256)
    size = known.agg(F.sum(F.length("license_id") + 100)).first()[0] or 0  # a digest has 64 bytes
    small = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
    texts = known.select("license_id", canonical(F.col("text")).alias("canonical")).where(F.col("canonical") != "")
    table = texts.select("license_id", F.sha2("canonical", 256).alias("digest")).groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("license"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    lines = rows.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    likely = lines.withColumn("head", first_word(F.col("line"))).join(small(opening_words(texts)), "head", "left_semi")
    found = likely.select("doc_id", digest(F.col("line")).alias("digest")).where(F.col("digest") != empty).join(small(table), "digest")
    hits = found.groupBy(F.col("doc_id").alias("of")).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = rows.select("doc_id", digest(F.col("text")).alias("digest")).join(small(table), "digest", "left")
    return whole.join(hits, F.col("doc_id") == F.col("of"), "left").select("doc_id", "digest", "license", "notices")


def sql() -> str:
    """The same lookup for DuckDB, with the default licences."""

    def canon(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), '{SQL_COPYRIGHT_LINE}', chr(10), 'g')"
        out = f"replace(' ' || trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g')) || ' ', ' ', '  ')"
        for found, written in _spaced():
            out = f"replace({out}, '{found}', '{written}')"
        return f"sha256(trim(replace({out}, '  ', ' ')))"

    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH k AS (
  SELECT string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS license, digest
  FROM (SELECT license_id, {canon("text")} AS digest FROM (VALUES {rows}) v(license_id, text)) GROUP BY digest),
l AS (
  SELECT DISTINCT doc_id, {canon("line")} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
h AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN k USING (digest) GROUP BY doc_id),
w AS (
  SELECT doc_id, {canon("text")} AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license, h.notices FROM w LEFT JOIN k USING (digest) LEFT JOIN h ON w.doc_id = h.doc_id"""
