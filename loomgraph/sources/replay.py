"""Outside services behind small protocols, with recorded answers for offline runs.

Nothing here opens a connection.  A caller passes a client object whose calls
run in Arrow batches on executors, with spacing, retries and a failure for each
item instead of for the whole job; ``Replay`` answers from a dictionary.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.udfs import json_in


class Client(Protocol):
    """One question, one answer; may raise Retry to be asked again or any other error to give up."""

    def ask(self, question: str) -> str: ...


class Retry(Exception):
    """The service is busy; ``after`` seconds is the least wait it asks for."""

    def __init__(self, after: float = 0.0):
        super().__init__(f"busy, wait {after} s")
        self.after = after


class Replay:
    """Recorded answers; an unknown question raises KeyError."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def ask(self, question: str) -> str:
        return self.answers[question]


class HashVectors:
    """Deterministic vectors in place of an embedding service."""

    def __init__(self, width: int = 16):
        self.width = width

    def embed(self, text: str) -> list[float]:
        raw = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(-(-self.width // 8)))
        return [int.from_bytes(raw[4 * i : 4 * i + 4], "little") / 2**31 - 1 for i in range(self.width)]


def patient(client: Client, question: str, tries: int = 4, wait: float = 5.0, most: float = 60.0, sleep=time.sleep) -> str:
    """Asks again after 5, 10, 20 ... seconds, or as long as the service says (at most ``most``)."""
    for k in range(tries):
        try:
            return client.ask(question)
        except Retry as busy:
            if k == tries - 1:
                raise
            sleep(min(most, max(busy.after, wait * 2**k)))
    raise AssertionError


def ask_all(rows: DataFrame, client: Client, question: str = "question", parallel: int = 6, spacing: float = 0.0, as_json: bool = False) -> DataFrame:
    """Adds ``answer`` and ``error`` to rows; at most ``parallel`` tasks ask at once.

    With ``as_json`` an answer is the JSON in the text; if there is none, the
    client is asked once to repair it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for q in batch[question]:
                try:
                    said = patient(client, q)
                    if as_json and json_in(said) is None:
                        said = patient(client, f"repair JSON: {said}")
                    answers.append(json_in(said) if as_json else said)
                    errors.append(None)
                except Exception as e:  # one failed item doesn't end the batch
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                time.sleep(spacing)
            yield batch.assign(answer=answers, error=errors)

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
    return rows.repartition(parallel).mapInPandas(run, schema)


def embed_all(rows: DataFrame, model, column: str = "text") -> DataFrame:
    """Adds ``embedding`` to rows (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": [model.embed(t) for t in batch[column]]})

    return rows.select("id", column).mapInPandas(run, "id long, embedding array<float>")


class RecordedPages(DataSource):
    """spark.read.format("recorded_pages").option("path", dir): page records, a JSON object on each line of *.jsonl files."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "lang string, page_id long, title string, revision_id long, text string, redirects array<string>, categories array<string>, links array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options["path"])


class _PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.jsonl"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json

        from ..schema import MAX_PAGE

        with open(partition.value, encoding="utf-8") as lines:
            for line in lines:
                p = json.loads(line)
                yield (p["lang"], p["page_id"], p["title"], p["revision_id"], p["text"][:MAX_PAGE], p.get("redirects", []), p.get("categories", []), p.get("links", []))


def first_sitelink(rows: DataFrame, languages: tuple[str, ...] = ("zh", "en")) -> DataFrame:
    """(qid, lang, title, label) of the first available language of (qid, lang, title, label) rows."""
    from pyspark.sql import functions as F

    rank = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    return rows.where(F.col("lang").isin(*languages)).groupBy("qid").agg(F.min_by(F.struct("lang", "title", "label"), rank).alias("s")).select("qid", "s.*")
