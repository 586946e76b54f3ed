"""Connection lifecycle: downtime suggestions, suggestion list, health.

Input log: source, at (timestamp), kind in ('connected', 'disconnected', 'event'), seq
(tie order). Many sources are handled at once; a source is one connection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.scan import ordinal, running_max_before

DOWNTIME_MIN_GAP_SECS = 300


def downtime_gaps(log: DataFrame, min_gap_seconds: int = DOWNTIME_MIN_GAP_SECS) -> DataFrame:
    """At each connect, checkpoint = first non-null of the last disconnect, the last
    event and the last connect before it (Q12: an old disconnect outranks a newer event);
    suggest [checkpoint, connect] when the gap is at least ``min_gap_seconds``. Unique windows."""
    us = F.unix_micros("at")
    marked = running_max_before(
        log, ["source"], [F.col("at"), F.col("seq")],
        {"last_disconnect": F.when(F.col("kind") == "disconnected", us),
         "last_event": F.when(F.col("kind") == "event", us),
         "last_connect": F.when(F.col("kind") == "connected", us)})
    conn = marked.where(F.col("kind") == "connected").select(
        "source", F.coalesce("last_disconnect", "last_event", "last_connect").alias("start_us"), us.alias("end_us"))
    return conn.where(F.col("start_us").isNotNull() & (F.col("end_us") - F.col("start_us") >= min_gap_seconds * 1000000)
                      ).distinct()


def pending_suggestions(gaps: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions still pending; the first decision on a suggestion is final
    (accept/dismiss only from pending). ``position``: newest start first, then newest end, then source."""
    decided = decisions.select("source", "start_us", "end_us").distinct()
    rows = gaps.join(decided, ["source", "start_us", "end_us"], "left_anti").withColumn("_all", F.lit(0))
    return ordinal(rows, ["_all"], [F.desc("start_us"), F.desc("end_us"), F.col("source")], "position").drop("_all")


def decision_state(gaps: DataFrame, decisions: DataFrame) -> DataFrame:
    """State of every suggestion: the earliest decision wins, else pending."""
    first = decisions.groupBy("source", "start_us", "end_us").agg(F.min_by("decision", "decided_at").alias("decision"))
    return gaps.join(first, ["source", "start_us", "end_us"], "left").select(
        "source", "start_us", "end_us", F.coalesce("decision", F.lit("pending")).alias("state"))


def health(log: DataFrame) -> DataFrame:
    """Per source, socket state from the latest connect/disconnect and the last time of each kind."""
    cd = F.col("kind").isin("connected", "disconnected")
    return log.groupBy("source").agg(
        F.coalesce(F.max_by(F.when(cd, F.col("kind")), F.when(cd, F.struct("at", "seq"))), F.lit("unknown")).alias("state"),
        F.max(F.when(F.col("kind") == "connected", F.col("at"))).alias("last_connected_at"),
        F.max(F.when(F.col("kind") == "disconnected", F.col("at"))).alias("last_disconnected_at"),
        F.max(F.when(F.col("kind") == "event", F.col("at"))).alias("last_event_at"),
    )
