"""Digest grouping, ordering and packing.

Input is a *selection*: narrow message rows (see ``inbox.NARROW``) plus scope columns
(a consumer, or a thread key for thread reads). Output frames:

* ``members``: one row per selected message with its group and member order,
* ``groups``: one row per group with cost and the group order key,
* a batch: the groups of the first batch, or the anchored prefix of an oversized first group.

Skew: a thread is aggregated with partial aggregation; channel windows are found on a
table of (channel, time bucket) summaries, so a busy channel never becomes one window
partition; the first batch reads at most ``budget // 24 + 1`` groups per scope.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.cost import MAX_BUDGET, MIN_BUDGET, MIN_COST
from threadloom.operators.scan import first_k, ordinal
from threadloom.operators.segments import with_segment
from threadloom.plans.stage import stage

DEFAULT_GAP_SECS = 300
MIN_GAP_SECS, MAX_GAP_SECS = 30, 3600

GROUP_ORDER = ["first_secs", "kind_rank", "ins_secs", "ins_tie", "window_no"]
MEMBER_ORDER = ["_not_root", "secs", "_tie"]


def _check_budget(budget: int) -> None:
    if not MIN_BUDGET <= budget <= MAX_BUDGET:
        raise ValueError("budget must be within 128..100000")


@dataclass
class Grouped:
    members: DataFrame
    groups: DataFrame
    scope: list[str]


def group_messages(sel: DataFrame, scope: Sequence[str], gap_seconds: int = DEFAULT_GAP_SECS,
                   tiebreak: str = "event_sequence") -> Grouped:
    """Thread groups and channel windows of a selection, per scope.

    ``tiebreak`` orders messages of equal second: ``event_sequence`` for inbox digests,
    ``message_ts`` (text) for thread reads.
    """
    if not MIN_GAP_SECS <= gap_seconds <= MAX_GAP_SECS:
        raise ValueError("gap_seconds must be within 30..3600")
    scope = list(scope)
    chan = [*scope, "workspace_id", "channel_id"]
    sel = sel.withColumn("_tie", F.col(tiebreak))

    # G1: a message is a root when a selected message of its channel names it as thread_ts
    reply_keys = (sel.where(F.col("thread_ts").isNotNull())
                  .select(*chan, F.col("thread_ts").alias("message_ts")).distinct()
                  .withColumn("_named", F.lit(True)))
    s = sel.join(reply_keys, [*chan, "message_ts"], "left")
    thread_key = F.coalesce(F.col("thread_ts"), F.when(F.col("_named"), F.col("message_ts")))
    s = s.withColumn("thread_key", thread_key).drop("_named")

    # Threads, root first (a message whose ts is the thread key; one per thread after D2)
    t = s.where(F.col("thread_key").isNotNull()).withColumn(
        "_not_root", (F.col("message_ts") != F.col("thread_key")).cast("int"))
    thread_groups = t.groupBy(*chan, "thread_key").agg(
        F.min(F.when(F.col("_not_root") == 0, F.struct("secs", "_tie"))).alias("_root"),
        F.min(F.struct("secs", "_tie")).alias("_ins"),
        F.sum("cost").alias("cost"),
        F.count(F.lit(1)).alias("n_messages"),
    )
    first = F.coalesce(F.col("_root"), F.col("_ins"))
    groups_t = thread_groups.select(
        *scope,
        F.concat_ws(":", "workspace_id", "channel_id", "thread_key").alias("group_id"),
        F.lit("thread").alias("kind"), "workspace_id", "channel_id",
        F.col("thread_key").alias("thread_ts"),
        first["secs"].alias("first_secs"), F.lit(0).alias("kind_rank"),
        F.col("_ins")["secs"].alias("ins_secs"), F.col("_ins")["_tie"].cast("string").alias("ins_tie"),
        F.lit(0).cast("bigint").alias("window_no"),
        F.col("cost").cast("bigint").alias("cost"), F.col("n_messages").cast("bigint").alias("n_messages"),
    )
    members_t = t.withColumn("group_id", F.concat_ws(":", "workspace_id", "channel_id", "thread_key"))

    # Channel windows via time buckets of width gap: no break can fall inside a bucket
    w = (s.where(F.col("thread_key").isNull()).withColumn("_not_root", F.lit(0))
         .withColumn("_bucket", F.floor(F.col("secs") / F.lit(gap_seconds))))
    buckets = w.groupBy(*chan, "_bucket").agg(
        F.min("secs").alias("_lo"), F.max("secs").alias("_hi"),
        F.min(F.struct("secs", "_tie", "event_sequence")).alias("_bfirst"),
        F.sum("cost").alias("_bcost"), F.count(F.lit(1)).alias("_bn"),
    )
    bw = Window.partitionBy(*chan).orderBy("_bucket")
    upto = bw.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev_hi = F.lag("_hi").over(bw)
    brk = (prev_hi.isNull() | ((F.col("_lo") - prev_hi) > gap_seconds)).cast("bigint")
    buckets = (buckets.withColumn("_brk", brk)
               .withColumn("window_no", F.sum("_brk").over(upto))
               .withColumn("_wfirst", F.last(F.when(F.col("_brk") == 1, F.col("_bfirst")), ignorenulls=True).over(upto))
               .withColumn("_cfirst", F.first("_bfirst").over(upto)))
    win_id = F.concat_ws(":", "workspace_id", "channel_id", F.col("_wfirst")["event_sequence"].cast("string"))
    members_w = w.join(buckets.select(*chan, "_bucket", "window_no", "_wfirst"), [*chan, "_bucket"]).withColumn(
        "group_id", win_id)
    win = buckets.groupBy(*chan, "window_no", "_wfirst", "_cfirst").agg(
        F.sum("_bcost").alias("cost"), F.sum("_bn").alias("n_messages"))
    groups_w = win.select(
        *scope, win_id.alias("group_id"), F.lit("channel_window").alias("kind"), "workspace_id", "channel_id",
        F.lit(None).cast("string").alias("thread_ts"),
        F.col("_wfirst")["secs"].alias("first_secs"), F.lit(1).alias("kind_rank"),
        F.col("_cfirst")["secs"].alias("ins_secs"), F.col("_cfirst")["_tie"].cast("string").alias("ins_tie"),
        F.col("window_no").cast("bigint"), F.col("cost").cast("bigint"), F.col("n_messages").cast("bigint"),
    )

    keep = [*scope, "group_id", *[c for c in sel.columns if c not in scope and c != "_tie"], "_not_root", "_tie"]
    members = members_t.select(*keep).unionByName(members_w.select(*keep))
    return Grouped(members=members, groups=groups_t.unionByName(groups_w), scope=scope)


def staged(grouped: Grouped, name: str) -> Grouped:
    """Materialise members and groups once; the batch steps read them several times."""
    return Grouped(members=stage(grouped.members, f"{name}-members"),
                   groups=stage(grouped.groups, f"{name}-groups"), scope=grouped.scope)


def group_order(tiebreak: str = "event_sequence") -> list[Column]:
    """First message second; threads before windows; then insertion order; then window number."""
    tie = F.col("ins_tie").cast("bigint") if tiebreak == "event_sequence" else F.col("ins_tie")
    return [F.col("first_secs"), F.col("kind_rank"), F.col("ins_secs"), tie, F.col("window_no")]


def member_order() -> list[Column]:
    return [F.col(c) for c in MEMBER_ORDER]


def ordered_groups(grouped: Grouped, tiebreak: str = "event_sequence") -> DataFrame:
    """Every group with its 1-based position in the scope's digest order (distributed)."""
    return ordinal(grouped.groups, grouped.scope, group_order(tiebreak), "group_position")


@dataclass
class Batch:
    groups: DataFrame      # delivered groups: scope, group_id, kind, ..., group_position, estimated_tokens, thread_continues
    messages: DataFrame    # delivered messages: scope, group_id, position, event_id, ..., text, text_continues, cost
    summary: DataFrame     # one row per scope: estimated_tokens, has_more, n_groups, n_delivered


def first_batch(grouped: Grouped, budget: int, tiebreak: str = "event_sequence") -> tuple[DataFrame, DataFrame]:
    """Whole groups in digest order while the running cost stays within ``budget``.

    Returns (candidates, selected). Every group costs at least 24, so no more than
    ``budget // 24`` groups can fit: only that many per scope are ranked.
    """
    _check_budget(budget)
    scope = grouped.scope
    k = budget // MIN_COST + 1
    top = first_k(grouped.groups, scope, group_order(tiebreak), k, "group_position")
    running = F.sum("cost").over(Window.partitionBy(*scope).orderBy("group_position")
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = top.withColumn("running_cost", running)
    return top, top.where(F.col("running_cost") <= budget)


# Delivered messages are joined to the texts by a broadcast of their ids only up to this many rows.
BROADCAST_IDS = 200_000


def _with_text(delivered: DataFrame, messages: DataFrame) -> DataFrame:
    """Join text and user fields to delivered rows. Their number is bounded by scopes x budget // 24 and measured
    here: a small set travels to the message scan, a large one is joined by a shuffle."""
    delivered = stage(delivered, "delivered")
    ids = F.broadcast(delivered) if delivered.count() <= BROADCAST_IDS else delivered
    return messages.select("event_id", "user_id", "subtype", "text").join(ids, "event_id")


def make_batch(grouped: Grouped, messages: DataFrame, budget: int, tiebreak: str = "event_sequence",
               eligible_col: str | None = "eligible", scopes: DataFrame | None = None, upper: int | None = None) -> Batch:
    """The first batch per scope, with the oversized-group fallback.

    ``messages`` supplies text and user fields by event_id for delivered rows only. ``scopes`` lists the
    scopes that must have a summary row even when nothing waits for them.
    """
    scope = grouped.scope
    top, selected = first_batch(grouped, budget, tiebreak)
    top = stage(top, "batch-candidates")
    selected = top.where(F.col("running_cost") <= budget)
    # G8 applies where the first group alone exceeds the budget (then nothing was selected)
    oversized = top.where((F.col("group_position") == 1) & (F.col("cost") > budget))
    elig = F.col(eligible_col) if eligible_col else F.lit(True)

    # members of picked groups only: of an oversized group as many as could fit
    picked = selected.select(*scope, "group_id", F.lit(0).alias("_big")).unionByName(oversized.select(*scope, "group_id", F.lit(1).alias("_big")))
    chosen = first_k(grouped.members.join(picked, [*scope, "group_id"]), [*scope, "group_id"], member_order(), budget // MIN_COST + 1, "position")
    rows = _with_text(chosen.select(*scope, "group_id", "_big", "position", "event_id", "event_sequence", "message_ts", "cost",
                                    elig.alias("eligible")), messages)
    columns = [*scope, "group_id", "position", "event_id", "event_sequence", "message_ts", "user_id", "subtype", "text"]
    whole = rows.where("_big = 0").select(*columns, F.lit(None).cast("int").alias("text_continues"), "cost", "eligible")

    # oversized first group: anchored prefix, first message segmented when needed
    big = rows.where("_big = 1")
    first_row = F.col("position") == 1
    heads = with_segment(big.where(first_row), budget).select(
        *big.columns, F.col("seg_text").alias("_text"), F.col("text_continues").alias("_cont"), F.col("seg_cost").alias("_cost"))
    big = heads.unionByName(big.where(~first_row).select(
        "*", F.col("text").alias("_text"), F.lit(None).cast("int").alias("_cont"), F.col("cost").alias("_cost")))
    big = big.withColumn("_run", F.sum("_cost").over(
        Window.partitionBy(*scope, "group_id").orderBy("position")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    partial = big.where(first_row | (F.col("_run") <= budget)).select(
        *columns[:-1], F.col("_text").alias("text"), F.col("_cont").alias("text_continues"), F.col("_cost").alias("cost"), "eligible")

    delivered = stage(whole.unionByName(partial), "batch-messages")
    taken = delivered.groupBy(*scope, "group_id").agg(F.sum("cost").alias("_tokens"), F.count(F.lit(1)).alias("_n"))
    groups_out = (selected.unionByName(oversized).join(taken, [*scope, "group_id"]).select(
        *scope, "group_id", "kind", "workspace_id", "channel_id", "thread_ts", "group_position",
        F.col("_tokens").cast("bigint").alias("estimated_tokens"), "n_messages", (F.col("_n") < F.col("n_messages")).alias("thread_continues")))
    summary = grouped.groups.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_groups"))
    if scopes is not None:
        summary = scopes.select(*scope).distinct().join(summary, scope, "left")
    totals = groups_out.groupBy(*scope).agg(F.sum("estimated_tokens").alias("estimated_tokens"), F.count(F.lit(1)).alias("n_delivered"))
    n_sel = selected.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n_sel"))
    none = F.lit(0).cast("bigint")
    summary = summary.join(totals, scope, "left").join(n_sel, scope, "left").select(
        *scope, F.coalesce("estimated_tokens", none).alias("estimated_tokens"),
        (F.coalesce("_n_sel", none) < F.coalesce("n_groups", none)).alias("has_more"),
        F.coalesce("n_groups", none).alias("n_groups"), F.coalesce("n_delivered", none).alias("n_delivered"),
        F.lit(upper).cast("bigint").alias("upper_sequence"))
    return Batch(groups=groups_out, messages=delivered, summary=summary)


def inbox_groups(messages: DataFrame, acks: DataFrame, consumers: Sequence[str], as_of, settle_seconds: int = 90,
                 gap_seconds: int = DEFAULT_GAP_SECS, upper=None) -> tuple[Grouped, int]:
    """G13 up to the groups: I1 -> I3 -> I4 -> G1-G5 for every consumer at once, and the upper sequence.

    The texts are read once for their cost; the narrow columns and the selection are staged, members and groups are not,
    so who reads only one of them pays for that one.
    """
    from threadloom.operators import inbox

    narrow = stage(messages.select(*inbox.NARROW, "observed_at"), "inbox-messages")
    up = inbox.latest_sequence_value(narrow) if upper is None else upper
    pend = inbox.pending(narrow, acks, consumers, up, as_of, settle_seconds)
    sel = stage(inbox.hydrate_threads(pend, narrow, ["consumer_id"]), "inbox-selection")
    return group_messages(sel, ["consumer_id"], gap_seconds, "event_sequence"), up


def inbox_digest(messages: DataFrame, acks: DataFrame, consumers: Sequence[str], as_of, budget: int,
                 settle_seconds: int = 90, gap_seconds: int = DEFAULT_GAP_SECS, upper=None) -> tuple[Grouped, Batch]:
    """``inbox_groups``, then the first batch (G6-G9) of every consumer in ``consumers``.

    ``messages`` must come from ``inbox.digest_ready``. ``upper`` defaults to I1. Of the groups, which the batch reads several
    times, a stage is written; the members are read once, for the picked groups.
    """
    _check_budget(budget)
    grouped, up = inbox_groups(messages, acks, consumers, as_of, settle_seconds, gap_seconds, upper)
    grouped = Grouped(members=grouped.members, groups=stage(grouped.groups, "inbox-groups"), scope=grouped.scope)
    everyone = messages.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(consumers)], "consumer_id string")
    return grouped, make_batch(grouped, messages, budget, "event_sequence", scopes=everyone, upper=up)


# ---------------------------------------------------------------- S8


MESSAGE_JSON = "eventId string, messageTs string, userId string, subtype string, text string, textContinues int"


def digest_documents(batch: Batch, ws_meta: DataFrame, ch_meta: DataFrame) -> DataFrame:
    """One row per delivered group: scope, ``group_position`` and the group as nested JSON, with names.

    A group's messages are bounded by the budget. The raw payload is not part of it.
    """
    from threadloom.operators.reports import with_names

    scope = [c for c in batch.messages.columns[:batch.messages.columns.index("group_id")]]
    one = F.struct(F.col("event_id").alias("eventId"), F.col("message_ts").alias("messageTs"), F.col("user_id").alias("userId"),
                   "subtype", "text", F.col("text_continues").alias("textContinues"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", one.alias("m")))), lambda x: x["m"])
    texts = batch.messages.groupBy(*scope, "group_id").agg(ordered.alias("messages"))
    named = with_names(batch.groups, ws_meta, ch_meta).join(texts, [*scope, "group_id"])
    body = F.struct(F.col("group_id").alias("id"), "kind", F.col("workspace_id").alias("workspaceId"),
                    F.col("workspace_name").alias("workspaceName"), F.col("channel_id").alias("channelId"),
                    F.col("channel_name").alias("channelName"), F.col("thread_ts").alias("threadTs"),
                    F.col("thread_continues").alias("threadContinues"), F.col("estimated_tokens").alias("estimatedTokens"), "messages")
    return named.select(*scope, "group_position", body.alias("group"))


def write_digest(batch: Batch, ws_meta: DataFrame, ch_meta: DataFrame, path: str) -> None:
    """Delivered groups as JSON lines."""
    digest_documents(batch, ws_meta, ch_meta).write.mode("errorifexists").json(path)


THREAD_SCOPE = ["scope_ws", "scope_ch", "key_ts"]


def thread_digest(messages: DataFrame, keys: DataFrame, as_of, budget: int, settle_seconds: int = 90,
                  markers: DataFrame | None = None, include_root: bool = True) -> tuple[Grouped, Batch]:
    """I5 -> I6 -> I7 -> G1-G9 per requested thread; every settled thread message is ackable.

    Ties order by message_ts text, as a thread read does. A read left with only its root
    becomes a channel window (Q15). Every distinct requested thread has a summary row, also one without settled
    messages, and its upper sequence is the latest of all messages (I1). A null in a requested key reads nothing.
    """
    from threadloom.operators import inbox

    upper = inbox.latest_sequence_value(messages.select("event_sequence"))
    asked = keys.select(F.col("workspace_id").alias("scope_ws"), F.col("channel_id").alias("scope_ch"), F.col("thread_ts").alias("key_ts"))
    thread = inbox.get_thread(messages, keys, as_of, settle_seconds)
    if markers is not None:
        thread = inbox.thread_after(thread, markers)
    if not include_root:
        thread = inbox.exclude_root(thread)
    sel = (thread.withColumn("scope_ws", F.col("workspace_id")).withColumn("scope_ch", F.col("channel_id"))
           .select(*THREAD_SCOPE, *inbox.NARROW).withColumn("eligible", F.lit(True)))
    grouped = staged(group_messages(stage(sel, "thread-selection"), THREAD_SCOPE, DEFAULT_GAP_SECS, "message_ts"),
                     "thread")
    return grouped, make_batch(grouped, messages, budget, "message_ts", scopes=asked, upper=upper)
