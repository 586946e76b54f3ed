"""Reports (M1, M2) and names on messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import display_name, message_instant
from threadloom.operators.scan import ordinal


def with_names(df: DataFrame, ws_meta: DataFrame, ch_meta: DataFrame) -> DataFrame:
    """Workspace and channel names by left joins; metadata has one row per key, and
    adaptive execution broadcasts it when its measured size is small."""
    w = ws_meta.select("workspace_id", "workspace_name")
    c = ch_meta.select("workspace_id", "channel_id", "channel_name")
    return df.join(w, ["workspace_id"], "left").join(c, ["workspace_id", "channel_id"], "left")


def list_channels(targets: DataFrame, messages: DataFrame, ws_meta: DataFrame, ch_meta: DataFrame) -> DataFrame:
    """M1: every target with names, enabled flag, message count and last observed time.

    Messages are aggregated per channel before the join (eager aggregation), so the join
    sees one row per channel. ``position`` is the order of the list: last observed first, channels
    without messages last, then by channel and workspace.
    """
    counts = messages.groupBy("workspace_id", "channel_id").agg(
        F.count("event_id").alias("message_count"), F.max("observed_at").alias("last_observed_at"))
    j = with_names(targets.select("workspace_id", "channel_id", "enabled")
                   .join(counts, ["workspace_id", "channel_id"], "left"), ws_meta, ch_meta)
    j = ordinal(j.withColumn("_all", F.lit(0)), ["_all"], [F.desc_nulls_last("last_observed_at"), F.col("channel_id"), F.col("workspace_id")], "position")
    return j.select("position", "workspace_id", "workspace_name", "channel_id", "channel_name", "enabled",
                    F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count"), "last_observed_at",
                    display_name("workspace_name", "workspace_id").alias("workspace_ref"),
                    display_name("channel_name", "channel_id").alias("channel_ref"))


def status(raw: DataFrame, messages: DataFrame, targets: DataFrame) -> DataFrame:
    """M2: one row of counts and times; each part is a one-row aggregate."""
    r = raw.agg(F.count(F.lit(1)).alias("events"), F.max("received_at").alias("last_received_at"))
    m = messages.agg(F.count(F.lit(1)).alias("messages"),
                     F.min(message_instant("message_ts")).alias("earliest_message_at"))
    t = targets.agg(F.count_if(F.col("enabled")).alias("channels"))
    # three single-row aggregates side by side: a join on a constant key
    one = F.lit(1).alias("_k")
    return (r.select("*", one).join(m.select("*", one), "_k").join(t.select("*", one), "_k").drop("_k"))
