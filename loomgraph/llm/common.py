"""What several operators share: work tables, exact copies and components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other bytes than these six separators.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is missing (tests on one machine) is a local
    temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds at once: whole texts travel in batches of ``rows``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Spark's switch that removes the shuffle files of a statement when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Work:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame, name: str, compression: str = "snappy", free: bool = False) -> DataFrame:
        """``df``, written and read again; ``free`` removes the write's shuffle files when it ends, whenever garbage is collected."""
        self.made += 1
        path = f"{self.root}/{self.made}-{name}"
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true" if free else before)
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        # Shuffle files of finished queries go when the driver's garbage is collected.
        gc.collect()
        self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._work_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: A class is hot if it holds more than one in so many of all rows; so at most so many are.
HOT_SHARE = 1000


def with_class(rows: DataFrame, classes: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with their class, whatever share of them one class holds; ``how`` is inner or left.

    ``classes`` has one row for each value of ``on``, and in ``size`` the number
    of its rows, which are ``total`` at least in all.  Classes over a
    HOT_SHARE-th of that are HOT_SHARE at most, so those are broadcast and their
    rows stay where they are; the others meet by shuffle.
    """
    least = total // HOT_SHARE
    hot = F.broadcast(classes.where(F.col(size) > least))
    cold = rows.join(hot.select(*on), on, "left_anti").join(classes.where(F.col(size) <= least), on, how)
    return rows.join(hot, on).unionByName(cold)


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    edge = lambda at: F.when(F.element_at(parts, at) == "", 1).otherwise(0)
    return F.when(F.size(parts) == 1, F.lit(1) - edge(1)).otherwise(F.size(parts) - edge(1) - edge(-1)).cast("long")


def components(work: Work, edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``edges`` (a, b): (node, label).

    First every node's links are bent to its least neighbour, which leaves
    about one link for each node and keeps what is connected.  Then minimum
    labels travel along links and jump through their own label, so a path of n
    nodes needs about log n rounds; every round but the last lowers a label.  Labels stay distributed; the driver only
    learns whether any changed.
    """
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    bent = edges.join(least, "b").select(F.explode(F.array(F.struct("m", F.col("b").alias("x")), F.struct("m", F.col("a").alias("x")))).alias("e")).select("e.*").where("m <> x").distinct()
    bent = work.table(bent, "bent")
    both = work.table(bent.select(F.col("m").alias("src"), F.col("x").alias("dst")).union(bent.select("x", "m")).distinct(), "links")
    work.drop(bent)
    labels = work.table(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("seen"))
        near = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("jumped"))
        new = work.table(near.join(jump, "near").select("node", "old", F.least("near", "jumped").alias("label")), "labels")
        work.drop(labels)
        labels = new.select("node", "label")
        labels._work_path = new._work_path
        if new.where("label <> old").isEmpty():
            work.drop(both)
            return labels
