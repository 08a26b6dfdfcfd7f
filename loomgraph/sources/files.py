"""Section bodies from text, HTML and PDF files."""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.udfs import html_text


def page_range(locator: str) -> tuple[int, int]:
    """(first, last) of ``pages:a-b``."""
    found = re.fullmatch(r"pages:(\d+)-(\d+)", locator)
    if not found:
        raise ValueError(f"a pdf locator is pages:first-last: {locator}")
    return int(found[1]), int(found[2])


def text_bodies(spark: SparkSession, sections: DataFrame, root: str) -> DataFrame:
    """(book, sec_id, body) of sections whose locator is path:FILE below ``root``; files are read whole by Spark."""
    wanted = sections.where(F.col("url").startswith("path:")).select("book", "sec_id", F.concat(F.lit(f"{root.rstrip('/')}/"), F.substring("url", 6, 1 << 20)).alias("path"))
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.join(wanted, F.endswith(F.url_decode("file"), F.regexp_replace("path", "^file:", ""))).select("book", "sec_id", strip(F.col("value")).alias("body"))


def html_bodies(fetched: DataFrame) -> DataFrame:
    """(book, sec_id, body) of fetched pages (book, sec_id, html)."""
    return fetched.select("book", "sec_id", html_text("html").alias("body"))


@F.pandas_udf(T.StringType())
def pdf_text(content: pd.Series, locator: pd.Series) -> pd.Series:
    """Text of a page range; needs the pdftotext program on executors."""
    if not shutil.which("pdftotext"):
        raise RuntimeError("pdftotext is not installed; give the section a path: locator instead")
    out = []
    for body, where in zip(content, locator, strict=True):
        first, last = page_range(where)
        with tempfile.NamedTemporaryFile(suffix=".pdf") as f:  # read back by this very task
            f.write(body)
            f.flush()
            done = subprocess.run(["pdftotext", "-f", str(first), "-l", str(last), "-layout", f.name, "-"], capture_output=True, timeout=120, check=True)
        out.append(done.stdout.decode("utf-8", "replace").strip())
    return pd.Series(out)


def pdf_bodies(spark: SparkSession, sections: DataFrame, pdfs: str) -> DataFrame:
    """(book, sec_id, body) of pages:a-b sections of PDF files BOOK.pdf in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(pdfs).select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("book"), "content")
    rows = sections.where(F.col("url").startswith("pages:")).join(files, "book")
    return rows.select("book", "sec_id", pdf_text("content", "url").alias("body"))
