"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed features; n-grams have 1 to GRAMS characters.
BITS, GRAMS = 15, 3
#: Bound on the labelled documents that a model is fitted on (their expected number).
FIT_DOCS = 20_000
#: Additive smoothing of feature counts.
SMOOTH = 0.5
UNKNOWN = "und"
#: Characters whose features are computed at once, and features of a part of a batch.
PIECE, PART = 1 << 20, 1 << 17


def features(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of the lower-cased text, in pieces of bounded size."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for at in range(0, len(cps), PIECE):
        part = cps[at : at + PIECE + GRAMS - 1].astype(np.uint32)
        new = min(PIECE, len(cps) - at)
        h, out = part * np.uint32(0x9E3779B1), []
        for n in range(1, GRAMS + 1):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + part[n - 1 :] * np.uint32(0xC2B2AE3D)
            g = h[:new]
            g = (g ^ (g >> np.uint32(13))) * np.uint32(0x27D4EB2F)
            out.append(g >> np.uint32(32 - BITS))
        yield np.concatenate(out)


@dataclass
class Model:
    """Labels in code point order, log priors and the log-probability matrix (features x labels)."""

    labels: list[str]
    prior: np.ndarray
    table: np.ndarray

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Labels and posteriors of a batch of texts.

        The batch is a sparse matrix of counts (texts x features) in parts of
        bounded size; each part is multiplied with the log-probability matrix
        by gathering the rows of its features and summing those of a text.
        """
        labels, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        told = np.array([i for i, x in enumerate(texts) if self.labels and x is not None and any(map(str.isalpha, x))], dtype=np.int64)
        if not len(told):
            return labels, score
        total = np.tile(self.prior, (len(told), 1))
        rows, columns, held = [], [], 0
        for k, i in enumerate(told.tolist()):
            for f in features(texts[i]):
                rows.append(np.full(len(f), k))
                columns.append(f)
                held += len(f)
                if held >= PART:
                    self._add(total, rows, columns)
                    rows, columns, held = [], [], 0
        self._add(total, rows, columns)
        best = total.argmax(axis=1)
        score[told] = np.round(1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 6)
        for i, b in zip(told.tolist(), best.tolist(), strict=True):
            labels[i] = self.labels[b]
        return labels, score

    def _add(self, total: np.ndarray, rows: list[np.ndarray], columns: list[np.ndarray]) -> None:
        """Adds the product of a sparse part and the matrix to the texts' sums."""
        if not rows:
            return
        row, column = np.concatenate(rows), np.concatenate(columns)
        first = int(row[0])
        cell = np.sort(((row - first) << BITS) | column)
        new = np.flatnonzero(np.diff(cell, prepend=-1))
        times, cell = np.diff(np.append(new, len(cell))), cell[new]
        row = cell >> BITS
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        own = self.table[cell & ((1 << BITS) - 1)] * times[:, None]
        total[first + row[starts]] += np.add.reduceat(own, starts, axis=0)


def held_out(key: Column) -> Column:
    """Documents that no model is learned from; a null key is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", most: int = FIT_DOCS) -> Model:
    """Counts n-grams of documents with text and label, chosen by a hash of the key.

    Every label gives about ``most`` / number of labels documents, or all it
    has, so a rare label is learned at any size of the input; priors are
    counted over all documents.  Counting is distributed: each task of the
    bounded sample sums its own counts and one aggregation adds them.  The
    driver receives the model: labels x 2**BITS numbers, whatever the size of
    the input.  Empty texts count for the prior only, repeated rows as often as
    they occur, and null keys are sampled as one; an empty table gives a model
    without labels.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(label).alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    each = max(1, most // max(1, len(sizes)))
    rates = [(x, int((1 << 30) * min(1.0, each / n))) for x, n in sizes.items()]
    rates = F.broadcast(docs.sparkSession.createDataFrame(rates, "label string, below long"))  # a row for each label, as in the model
    rows = rows.join(rates, "label").where(F.pmod(F.xxhash64("k", F.lit("fit")), F.lit(1 << 30)) < F.col("below"))
    rows = rows.select("text", "label").repartition(16)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for x, lang in zip(batch["text"], batch["label"], strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BITS, dtype=np.int64)
                for f in features(x):
                    sums[lang] += np.bincount(f, minlength=1 << BITS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"label": lang, "feature": at, "n": c[at]})

    found = rows.mapInPandas(count, "label string, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(sizes)
    table, prior = np.zeros((1 << BITS, len(labels))), np.array([float(sizes[x]) for x in labels])
    for i, lang in enumerate(labels):
        own = found[found["label"] == lang]
        table[own["feature"].to_numpy(), i] = own["n"].to_numpy()
    if labels:
        table = np.log(table + SMOOTH) - np.log((table + SMOOTH).sum(axis=0))
        prior = np.log(prior / prior.sum())
    return Model(labels, prior, table)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, told): each row of ``docs`` as a struct, and struct(lang, score): the label of the highest posterior, and that posterior.

    Only the text is looked at, all of it; the struct keeps other columns out
    of the way, whatever their names.  Every row is answered, repeated ones
    alike, and an empty table gives an empty result.  ``und`` with score 0 stands for a
    null text, a text without a letter, or a model without labels.  Ties go to
    the first label by code point.  The matrix travels as a broadcast variable;
    its size is fixed by BITS and the number of labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            lang, score = own.predict(batch.tolist())
            yield pd.DataFrame({"lang": lang, "score": score})

    return docs.select(F.struct(*docs.columns).alias("row"), predict(F.col(text)).alias("told"))
