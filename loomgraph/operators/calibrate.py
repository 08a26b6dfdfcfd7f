"""Reports on how well review, rules and signals agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .names import first_per

ITEM = ["item_type", "item_id"]


def _share(a: Column, n: Column) -> Column:
    return F.try_divide(a.cast("double"), n.cast("double"))


def first_decisions(log: DataFrame, decided_by: str = "human") -> DataFrame:
    """The first decision on each item by one kind of reviewer, audits included."""
    return first_per(log.where(F.col("decided_by") == decided_by), ITEM, F.col("created_at"), F.col("id"))


def last_audits(log: DataFrame) -> DataFrame:
    rows = log.where(F.col("action").isin("audit_confirm", "audit_reject"))
    return rows.groupBy(*ITEM).agg(F.max_by("action", F.struct("created_at", "id")).alias("audit"))


def unaudited(log: DataFrame) -> DataFrame:
    """Automatic approvals on items that nobody has audited."""
    auto = log.where("decided_by = 'auto' AND action = 'approve'")
    return auto.join(log.where(F.col("action").startswith("audit_")).select(*ITEM), ITEM, "left_anti")


def audit_sample(log: DataFrame, k: int, seed: int) -> DataFrame:
    return unaudited(log).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k)


def batches(log: DataFrame) -> DataFrame:
    """Automatic batches, newest first: (batch_id, decisions, approves, rejects, started)."""
    rows = log.where("decided_by = 'auto' AND batch_id <> ''").groupBy("batch_id")
    return rows.agg(F.count("*").alias("decisions"), F.count_if(F.col("action") == "approve").alias("approves"), F.count_if(F.col("action") == "reject").alias("rejects"), F.min("created_at").alias("started")).orderBy(F.desc("started"), "batch_id")


def log_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(R.log_channel(F.col("source")).alias("channel"), "decided_by", "action").agg(F.count("*").alias("n"))


def human_precision(log: DataFrame, edges: DataFrame, signals: DataFrame) -> DataFrame:
    """First human decisions by channel, kind and signals: (channel, kind, bucket, approve, reject, other, n, precision).

    An item whose first decision is an audit is left out.
    """
    rows = first_decisions(log).where(~F.col("action").startswith("audit_")).select(*ITEM, "action", "source")
    rows = rows.join(edges.select(F.lit("edge").alias("item_type"), F.col("id").alias("item_id"), F.col("type").alias("edge_type")), ITEM, "left")
    rows = rows.join(signals.select(*ITEM, "signals", "llm_verdict", F.lit(True).alias("has")), ITEM, "left")
    kind = F.when(F.col("item_type") == "edge", F.coalesce("edge_type", F.lit("?"))).otherwise("node")
    label = F.when(F.col("has"), R.bucket(F.col("item_type"), F.col("signals"), F.col("llm_verdict"))).otherwise("无信号")
    count = lambda *names: F.count_if(F.col("action").isin(*names))
    out = rows.groupBy(R.channel(F.col("source")).alias("channel"), kind.alias("kind"), label.alias("bucket")).agg(count("approve").alias("approve"), count("reject").alias("reject"), F.count_if(~F.col("action").isin("approve", "reject")).alias("other"))
    out = out.withColumn("n", F.col("approve") + F.col("reject"))
    return out.withColumn("precision", _share(F.col("approve"), F.col("n"))).orderBy(F.desc(F.col("n") + F.col("other")), "channel", "kind", "bucket")


def auto_overturn(log: DataFrame) -> DataFrame:
    """Automatic approvals by channel and what audits say: (channel, approved, audited, overturn)."""
    rows = first_decisions(log, "auto").where("action = 'approve'").join(last_audits(log), ITEM, "left")
    out = rows.groupBy(R.channel(F.col("source")).alias("channel")).agg(F.count("*").alias("approved"), F.count("audit").alias("audited"), F.count_if(F.col("audit") == "audit_reject").alias("bad"))
    return out.select("channel", "approved", "audited", _share(F.col("bad"), F.col("audited")).alias("overturn")).orderBy("channel")


def shadow_agreement(log: DataFrame, signals: DataFrame, items: DataFrame) -> DataFrame:
    """How shadow decisions compare with first human ones: (channel, kind, shadow, agree, disagree, modified, pending, agreement).

    ``items`` is (item_type, item_id, source).
    """
    would = signals.select(*ITEM, F.col("signals.auto_would").alias("would")).where(F.col("would").isin("approve", "reject"))
    human = first_decisions(log).where(~F.col("action").startswith("audit_")).select(*ITEM, "action")
    rows = would.join(human, ITEM, "left").join(items, ITEM, "left")
    is_plain = F.col("action").isin("approve", "reject")
    out = rows.groupBy(R.channel(F.col("source")).alias("channel"), F.col("item_type").alias("kind")).agg(
        F.count("*").alias("shadow"), F.count_if(F.col("action") == F.col("would")).alias("agree"), F.count_if(is_plain & (F.col("action") != F.col("would"))).alias("disagree"),
        F.count_if(~is_plain).alias("modified"), F.count_if(F.col("action").isNull()).alias("pending"),
    )
    return out.withColumn("agreement", _share(F.col("agree"), F.col("agree") + F.col("disagree") + F.col("modified"))).orderBy("channel", "kind")
