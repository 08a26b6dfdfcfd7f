"""The corpus pipeline: stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import langid, line_runs, mixing, order_minhash, packing
from loomgraph.llm.common import Work, n_words, small_batches
from loomgraph.llm.queries import MIN_LINES, tokenizer

#: Least posterior of a language that is kept.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells; the others (no text, no letter, no clear label) go.

    Null, empty and blank texts go; texts are read whole, however long;
    repeated rows fare alike; a null doc_id or lang changes nothing but that a
    null lang isn't learned from; other columns pass through, whatever their
    names.  An empty table, or one without labels, gives an empty one.
    """
    small_batches(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    told = langid.identify(docs, model)
    return told.where((F.col("told.lang") != langid.UNKNOWN) & (F.col("told.score") >= LEAST_SCORE)).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that lose all their words go.

    A null or empty text is one empty line and stays as it is; rows of a null
    doc_id stay whole; repeated rows are one document and fare alike; ties
    don't occur, as runs are ordered by where they begin; an empty table gives
    an empty one; other columns pass through, whatever their names.
    """
    out = line_runs.line_dedup(docs, Work(spark, "lines"), MIN_LINES).where((F.col("n_removed") == 0) | (n_words(F.col("kept")) > 0))
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        size = F.length("kept").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, size).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the smallest doc_id, and of several texts of that id the one of least hash.

    Of rows with the same doc_id and text one stays, with its own other
    columns.  Null, empty and blank texts are classes of their own and stay.
    Rows of a null doc_id go if a document with an id has their text, else they
    stay.  An empty table gives an empty one; other columns pass through,
    whatever their names.
    """
    small_batches(spark)
    work = Work(spark, "near")
    found = order_minhash.near_duplicates(docs, work).select(F.col("doc_id").alias("id"), "x", "copy_of", "class_id")
    found = work.table(found.where("class_id IS NOT NULL AND copy_of IS NOT NULL").distinct(), "classes")
    first = found.where("id = class_id").groupBy("class_id").agg(F.min("x").alias("least"))
    # Gone are all rows of a class but those of its first text; blank texts are their own class and text.
    gone = found.join(first, "class_id").where("id IS NULL OR id <> class_id OR x <> least").select(F.col("id").alias("gone_id"), F.col("x").alias("gone_x"))
    gone = work.table(gone, "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("x"))
    kept = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("x") == F.col("gone_x")), "left_anti")
    once = kept.where(F.col("id").isNotNull()).dropDuplicates(["id", "x"]).select("row")
    return once.union(kept.where(F.col("id").isNull()).select("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null, empty and blank texts have no words: they count for nothing in the
    budgets, and are taken as often as other documents of their source and
    hash.  Ties and repeated rows fare alike; a null source is a source; an
    empty table gives an empty one; other columns pass through, whatever their
    names.
    """
    return mixing.mixed(docs, Work(spark, "mix")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences.

    A null or empty text is the end id alone; long texts are cut in pieces that
    hold all their ids; repeated rows and null ids are packed each; an empty
    table gives an empty one; other columns than doc_id and text are left out.
    """
    small_batches(spark)
    return packing.pack_documents(docs, Work(spark, "pack"), tokenizer())


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]
#: Language ID and near-dedup are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Work(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
