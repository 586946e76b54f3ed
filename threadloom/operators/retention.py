"""Retention (R1-R4): expiry with the thread-root exemption, index and ack cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import message_instant
from threadloom.operators.inbox import as_column

RAW_RETENTION_DAYS = 7
MESSAGE_RETENTION_DAYS = 30


def retain_raw(raw: DataFrame, as_of, days: int = RAW_RETENTION_DAYS) -> DataFrame:
    """Raw events received within ``days`` of ``as_of``; unreadable arrival times stay.

    A table that has ``received_date`` (the partition column of ingested data) is pruned by it.
    """
    cutoff = as_column(as_of) - F.make_interval(days=F.lit(days))
    if "received_date" in raw.columns:
        raw = raw.where(F.coalesce(F.col("received_date") >= F.to_date(cutoff), F.lit(True)))
    return raw.where(F.coalesce(F.col("received_at") >= cutoff, F.lit(True)))


def retain_messages(messages: DataFrame, as_of, days: int = MESSAGE_RETENTION_DAYS) -> DataFrame:
    """R2: messages newer than the cutoff, plus older roots whose thread has a recent reply.

    Adds ``kept_by_reply`` (true for an expired root kept alive by a recent reply). A message whose
    time cannot be read is never expired: its age is not known.
    """
    cutoff = as_column(as_of) - F.make_interval(days=F.lit(days))
    t = message_instant("message_ts")
    stays = F.coalesce(t >= cutoff, F.lit(True))
    recent = messages.where(stays)
    old = messages.where(~stays)
    live_roots = (recent.where(F.col("thread_ts").isNotNull())
                  .select("workspace_id", "channel_id", F.col("thread_ts").alias("message_ts")).distinct())
    kept = old.join(live_roots, ["workspace_id", "channel_id", "message_ts"], "left_semi")
    return (recent.withColumn("kept_by_reply", F.lit(False))
            .unionByName(kept.withColumn("kept_by_reply", F.lit(True))))


def retain_index(index: DataFrame, messages: DataFrame) -> DataFrame:
    """Thread-index entries whose root message is still stored."""
    roots = messages.select("workspace_id", "channel_id", F.col("message_ts").alias("root_ts"))
    return index.join(roots, ["workspace_id", "channel_id", "root_ts"], "left_semi")


def retain_acks(acks: DataFrame, messages: DataFrame) -> DataFrame:
    """Acknowledgements go with their message."""
    return acks.join(messages.select("event_id"), ["event_id"], "left_semi")
