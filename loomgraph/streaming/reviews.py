"""Reports that follow a growing review log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(S.REVIEW_LOG)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def counts_by_hour(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(hour, decided_by, action, n); rows later than ``late`` are left out, so state stays bounded."""
    timed = log.withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("hour"), "decided_by", "action").agg(F.count("*").alias("n"))


def first_decisions(log: DataFrame, decided_by: str = "human") -> DataFrame:
    """The first decision that arrives for each item."""
    return log.where(F.col("decided_by") == decided_by).dropDuplicates(["item_type", "item_id"])


def follow(log: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``apply`` with each new batch, exactly once per batch number, until all present rows are read."""
    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
