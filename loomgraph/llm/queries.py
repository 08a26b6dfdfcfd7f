"""The queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, idcoder, langid, licenses, line_runs, mixing, order_minhash, packing, permutation_ann, phrases
from .common import Work, small_batches

#: Lines of the shortest repeated run that is deleted.
MIN_LINES = 2


def tokenizer() -> str:
    """The vocabulary file; it is installed with Python on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), Work(spark, "pack"), tokenizer())


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(table(spark, sf_dir, "documents"), Work(spark, "audio"))[2]


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op4_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcoder.read_ids(idcoder.write_ids(table(spark, sf_dir, "documents"), Work(spark, "ids"), tokenizer()))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"), Work(spark, "near")).drop("x")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.line_dedup(table(spark, sf_dir, "documents"), Work(spark, "lines"), MIN_LINES)
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), Work(spark, "mix"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_dedup(table(spark, sf_dir, "documents"), Work(spark, "phrases")).drop("spans")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held_out))
    told = langid.identify(docs, model)
    return told.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Work(spark, "ann"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pack, op2_audio, op3_license_scan, op4_ids, op5_near_dup, op6_line_dedup, op7_mix, op8_phrases, op9_langid, op10_ann)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.sql(), "op6_line_dedup": line_runs.sql(MIN_LINES), "op7_mix": mixing.sql(), "op8_phrases": phrases.sql()}
