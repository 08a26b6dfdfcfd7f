"""Tables that steps write to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder in spark.checkpoint.dir; only local sessions without one get a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read again, which cuts its lineage."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Bounds what a Python worker holds at once: whole texts travel in batches of ``rows``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
