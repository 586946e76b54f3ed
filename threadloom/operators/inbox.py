"""Per-consumer inbox and acknowledgement.

Many consumers are served at once: a consumer column is carried through every step
and every join key includes it, so one plan answers the whole consumer list.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.scan import ordinal

DEFAULT_SETTLE_SECS = 90
MAX_SETTLE_SECS = 3600
RECEIPT_TTL_DAYS = 7

# Narrow message columns carried through inbox and digest steps; text joins back at the end.
NARROW = ["event_id", "event_sequence", "workspace_id", "channel_id", "message_ts", "thread_ts", "secs", "cost"]


def digest_ready(messages: DataFrame) -> DataFrame:
    """Add ``secs`` (N9) and ``cost`` (N13) once per stored message; empty thread_ts counts as none."""
    from threadloom.functions import message_cost, message_secs

    return (messages.withColumn("thread_ts", F.nullif(F.col("thread_ts"), F.lit("")))
            .withColumn("secs", message_secs("message_ts"))
            .withColumn("cost", message_cost()))


def as_column(value) -> Column:
    """Accept a Column, a datetime/number literal, or None."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        # naive datetimes are UTC wall time (the session zone is UTC)
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    return F.lit(value)


def latest_sequence(messages: DataFrame) -> DataFrame:
    """Highest event_sequence, 0 when there are no messages (one row)."""
    return messages.agg(F.coalesce(F.max("event_sequence"), F.lit(0)).cast("bigint").alias("latest_sequence"))


def latest_sequence_value(messages: DataFrame) -> int:
    """I1 fetched as one scalar, so later filters get a literal that reaches the Parquet scan."""
    return int(latest_sequence(messages).first()["latest_sequence"])


def settled(messages: DataFrame, as_of, settle_seconds: int = DEFAULT_SETTLE_SECS) -> DataFrame:
    """Keep messages that arrived at least ``settle_seconds`` before ``as_of``."""
    if not 0 <= settle_seconds <= MAX_SETTLE_SECS:
        raise ValueError("settle_seconds must be within 0..3600")
    cutoff = as_column(as_of) - F.make_interval(secs=F.lit(settle_seconds))
    return messages.where(F.col("observed_at") <= cutoff)


def changed_messages(messages: DataFrame, after, upper, as_of, settle_seconds: int = DEFAULT_SETTLE_SECS) -> DataFrame:
    """Settled messages with ``after < event_sequence <= upper``; order column is event_sequence."""
    rng = (F.col("event_sequence") > as_column(after)) & (F.col("event_sequence") <= as_column(upper))
    return settled(messages.where(rng), as_of, settle_seconds)


def with_consumers(df: DataFrame, consumers: Sequence[str]) -> DataFrame:
    """One copy of each row per consumer, from a literal list (bounded by the caller, no join)."""
    if not consumers:
        raise ValueError("at least one consumer is required")
    return df.withColumn("consumer_id", F.explode(F.array(*[F.lit(c) for c in consumers])))


def pending(messages: DataFrame, acks: DataFrame, consumers: Sequence[str], upper, as_of,
            settle_seconds: int = DEFAULT_SETTLE_SECS) -> DataFrame:
    """Per consumer, settled messages up to ``upper`` that this consumer has not acknowledged.

    Acks are gathered per message first (at most one entry a consumer), so a message is one row until it
    is known who still waits for it.
    """
    if not consumers:
        raise ValueError("at least one consumer is required")
    candidates = settled(messages.where(F.col("event_sequence") <= as_column(upper)), as_of, settle_seconds)
    done = (acks.where(F.col("consumer_id").isin(list(consumers))).groupBy("event_id")
            .agg(F.collect_set("consumer_id").alias("_acked")))
    everyone = F.array(*[F.lit(c) for c in dict.fromkeys(consumers)])
    waiting = F.array_except(everyone, F.coalesce("_acked", F.array().cast("array<string>")))
    return candidates.join(done, "event_id", "left").withColumn("consumer_id", F.explode(waiting)).drop("_acked")


def _thread_members(messages: DataFrame, keys: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Messages whose thread_ts or message_ts equals a key, as two equi joins."""
    narrow = messages.select(*NARROW)
    by_reply = narrow.join(
        keys.withColumnRenamed("key_ts", "thread_ts"), ["workspace_id", "channel_id", "thread_ts"], "inner")
    by_root = narrow.join(
        keys.withColumnRenamed("key_ts", "message_ts"), ["workspace_id", "channel_id", "message_ts"], "inner")
    cols = [*scope, *NARROW]
    return by_reply.select(*cols).unionByName(by_root.select(*cols))


def hydrate_threads(pending_df: DataFrame, messages: DataFrame, scope: Sequence[str] = ("consumer_id",)) -> DataFrame:
    """I4: pending messages plus every stored message of each thread touched by a pending reply.

    Hydrated members ignore settle and upper sequence (Q2). ``eligible`` marks rows that
    were pending themselves (only those can be acknowledged). Narrow columns only: text
    is joined back after the batch is chosen.
    """
    scope = list(scope)
    keys = (pending_df.where(F.col("thread_ts").isNotNull())
            .select(*scope, "workspace_id", "channel_id", F.col("thread_ts").alias("key_ts")).distinct())
    members = _thread_members(messages, keys, scope).withColumn("eligible", F.lit(False))
    mine = pending_df.select(*scope, *NARROW).withColumn("eligible", F.lit(True))
    both = mine.unionByName(members)
    # the rows of one event are equal but for the flag
    rest = [c for c in NARROW if c != "event_id"]
    return both.groupBy(*scope, "event_id").agg(*[F.first(c).alias(c) for c in rest], F.max("eligible").alias("eligible")).select(
        *scope, *NARROW, "eligible")


def get_thread(messages: DataFrame, keys: DataFrame, as_of, settle_seconds: int = DEFAULT_SETTLE_SECS) -> DataFrame:
    """For each key (workspace_id, channel_id, thread_ts) the settled root and replies.

    Output carries the key as ``key_ts``; text order is ``message_ts``.
    """
    k = keys.select("workspace_id", "channel_id", F.col("thread_ts").alias("key_ts")).distinct()
    s = settled(messages, as_of, settle_seconds)
    by_reply = s.join(k.withColumnRenamed("key_ts", "thread_ts"), ["workspace_id", "channel_id", "thread_ts"])
    by_root = s.join(k.withColumnRenamed("key_ts", "message_ts"), ["workspace_id", "channel_id", "message_ts"])
    by_reply = by_reply.withColumn("key_ts", F.col("thread_ts"))
    by_root = by_root.withColumn("key_ts", F.col("message_ts"))
    # a self-root (thread_ts = message_ts) matches both joins; keep one row
    both = by_reply.unionByName(by_root.where(F.col("thread_ts").isNull() | (F.col("thread_ts") != F.col("message_ts"))))
    return both


def thread_after(thread: DataFrame, markers: DataFrame) -> DataFrame:
    """The root plus replies with ``message_ts`` textually after the marker.

    ``markers``: workspace_id, channel_id, thread_ts, after_ts. Threads without a marker
    are returned whole.
    """
    m = markers.select("workspace_id", "channel_id", F.col("thread_ts").alias("key_ts"), "after_ts")
    j = thread.join(m, ["workspace_id", "channel_id", "key_ts"], "left")
    is_root = F.col("message_ts") == F.col("key_ts")
    keep = F.col("after_ts").isNull() | is_root | (F.col("message_ts") > F.col("after_ts"))
    return j.where(keep).drop("after_ts")


def exclude_root(thread: DataFrame) -> DataFrame:
    """Drop the root of each thread read."""
    return thread.where(F.col("message_ts") != F.col("key_ts"))


def get_messages(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """I8: messages by identity (workspace_id, channel_id, message_ts)."""
    k = keys.select("workspace_id", "channel_id", "message_ts").distinct()
    return messages.join(k, ["workspace_id", "channel_id", "message_ts"], "left_semi")


def acknowledge(requests: DataFrame, messages: DataFrame, acks: DataFrame, at=None) -> tuple[DataFrame, DataFrame]:
    """Classify requested ids per consumer and return (outcomes, new_acks).

    outcome: ``acknowledged`` (known, not yet acked: inserted), ``already`` (known and
    acked before), ``unknown`` (no such message). Duplicates in a request collapse.
    """
    req = requests.select("consumer_id", "event_id").distinct()
    known = req.join(messages.select("event_id"), ["event_id"], "left_semi").withColumn("_known", F.lit(True))
    had = acks.select("consumer_id", "event_id").distinct().withColumn("_had", F.lit(True))
    j = req.join(known, ["consumer_id", "event_id"], "left").join(had, ["consumer_id", "event_id"], "left")
    outcome = (F.when(F.col("_known").isNull(), F.lit("unknown"))
               .when(F.col("_had").isNull(), F.lit("acknowledged"))
               .otherwise(F.lit("already")))
    outcomes = j.select("consumer_id", "event_id", outcome.alias("outcome"))
    stamp = as_column(at) if at is not None else F.current_timestamp()
    new_acks = outcomes.where(F.col("outcome") == "acknowledged").select(
        "consumer_id", "event_id", stamp.cast("timestamp").alias("acknowledged_at"))
    return outcomes, new_acks


def acknowledge_lists(requests: DataFrame, messages: DataFrame, acks: DataFrame, at=None) -> tuple[DataFrame, DataFrame]:
    """I9 for requests with a list of ids each (consumer_id, event_ids): the distinct ids of all lists of a consumer.

    A null or empty list, and null ids in a list, ask for nothing.
    """
    each = requests.select("consumer_id", F.explode(F.array_distinct("event_ids")).alias("event_id"))
    return acknowledge(each.where(F.col("event_id").isNotNull()), messages, acks, at)


def in_read_order(rows: DataFrame, scope: Sequence[str], *order: str) -> DataFrame:
    """Add ``position``, from 1, of each row in its scope: by ``event_sequence`` for I2 and I3, by the text of ``message_ts`` for
    I5. ``order`` must be a total order in a scope; no scope is sorted in one task."""
    if scope:
        return ordinal(rows, scope, [F.col(c) for c in order], "position")
    return ordinal(rows.withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in order], "position").drop("_all")


def receipts(batch_messages: DataFrame, scope: Sequence[str] = ("consumer_id",)) -> DataFrame:
    """Ackable ids per delivered group.

    ``batch_messages``: one row per delivered message with group_id, position,
    thread_continues, text_continues and eligible. A group gets no receipt when the
    thread continues or any of its texts continues, or when none of its ids is eligible.
    Ids are distinct, in delivery order.
    """
    scope = list(scope)
    g = batch_messages.groupBy(*scope, "group_id").agg(
        F.max(F.col("thread_continues").cast("int")).alias("_tc"),
        F.max(F.col("text_continues").isNotNull().cast("int")).alias("_xc"),
        F.array_sort(F.collect_list(F.when(F.col("eligible"), F.struct("position", "event_id")))).alias("_ids"),
    )
    ids = F.array_distinct(F.transform("_ids", lambda s: s["event_id"]))
    return g.where((F.col("_tc") == 0) & (F.col("_xc") == 0) & (F.size("_ids") > 0)).select(
        *scope, "group_id", ids.alias("event_ids"))


def issue_receipts(receipt_ids: DataFrame, issued_at) -> DataFrame:
    """Receipts as rows; each expires RECEIPT_TTL_DAYS after issue."""
    at = as_column(issued_at).cast("timestamp")
    return receipt_ids.select("*", at.alias("issued_at"),
                              (at + F.make_interval(days=F.lit(RECEIPT_TTL_DAYS))).alias("expires_at"))


def valid_receipts(receipts_df: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Split receipts into (valid, rejected); rejected carry a reason.

    Malformed: missing consumer, no list of ids, a null id, no expiry (an empty list is well formed). Expired: expiry
    earlier than ``as_of``.
    """
    malformed = (F.col("consumer_id").isNull() | (F.col("consumer_id") == "") | F.col("event_ids").isNull()
                 | F.col("expires_at").isNull() | F.exists("event_ids", lambda x: x.isNull()))
    expired = F.col("expires_at") < as_column(as_of)
    reason = F.when(malformed, F.lit("malformed")).when(expired, F.lit("expired"))
    tagged = receipts_df.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def segment_receipts(segments: DataFrame, *extra: str) -> DataFrame:
    """A finished text (its final segment) is ackable for that one event only; ``extra`` columns stay."""
    return segments.where(F.col("text_continues").isNull()).select(
        *[c for c in ("consumer_id",) if c in segments.columns], "event_id", *extra)
