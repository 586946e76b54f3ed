"""One row format for the live, history and reply feeds (D5), so that one store takes all three.

A live envelope is one row. A page is one row for each item of its messages array, and one row if it has none or is
not ok, so that its error (S6) or its fetch (D9) is seen. Rows that carry no message have no ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.json_fields import count_field, is_object, str_field
from threadloom.sources import envelopes, history

ROW = ("feed string, received_at timestamp, arrival bigint, page_id string, ts_num decimal(20,6), item_no bigint, envelope_id string, "
       "event_id string, workspace_id string, api_app_id string, callback_type string, event_type string, event_ts string, "
       "channel_id string, message_ts string, thread_ts string, user_id string, subtype string, text string, payload string, "
       "event_payload string, reply_count bigint, latest_reply string, job_id bigint, root_ts string, page_error string, reject_reason string")
_FIELDS = [f.strip().split(" ", 1) for f in ROW.replace("(20,6)", "(20;6)").split(",")]

# Arrival over all feeds: pages in order of their fetch, a page's messages oldest first (D4), equal times in page order.
ARRIVAL = ["received_at", "arrival", "page_id", "ts_num", "item_no", "event_ts", "event_id"]

LIVE, HISTORY, REPLIES = "live", "history", "replies"
_CALLBACK = {HISTORY: history.HISTORY_CALLBACK, REPLIES: history.THREAD_CALLBACK}


def _conform(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t.replace(";", ",")).alias(n) for n, t in _FIELDS])


def live_rows(payloads: DataFrame) -> DataFrame:
    """Feed rows of parsed envelopes (``envelopes.envelope_payloads``), rejects with their reason."""
    return _conform(envelopes.with_reason(payloads).withColumn("feed", F.lit(LIVE)))


def page_rows(pages: DataFrame, feed: str) -> DataFrame:
    """Feed rows of history or reply pages (columns of ``history.PAGE_SCHEMA``).

    An item that is no message of the feed (no object, no text ``ts``, another type, another thread) keeps its row
    without an ``event_id``. Null workspaces, channels or fetch times pass through as nulls.
    """
    parsed = history.parse_pages(pages).withColumn("page_error", F.when(~F.col("ok"), history.page_error()))
    keep = ["page_id", "workspace_id", "channel_id", "root_ts", "job_id", "fetched_at", "page_error"]
    items = parsed.select(*keep, F.posexplode_outer(F.when(F.col("ok"), F.try_variant_get("page", "$.messages", "array<variant>")))
                          .alias("item_no", "m"))
    ts = str_field("m", "$.ts")
    usable = is_object("m") & ts.isNotNull() & history.is_history_item()
    if feed == REPLIES:
        usable = usable & history.in_thread()

    def of_message(column):
        return F.when(F.coalesce(usable, F.lit(False)), column)

    return _conform(items.select(
        *keep, F.lit(feed).alias("feed"), F.col("fetched_at").alias("received_at"), F.col("item_no").cast("bigint").alias("item_no"),
        of_message(ts.try_cast("decimal(20,6)")).alias("ts_num"), of_message(history.history_event_id()).alias("event_id"),
        F.lit(_CALLBACK[feed]).alias("callback_type"), of_message(F.lit("message")).alias("event_type"), of_message(ts).alias("event_ts"),
        of_message(ts).alias("message_ts"), of_message(str_field("m", "$.thread_ts")).alias("thread_ts"),
        of_message(str_field("m", "$.user")).alias("user_id"), of_message(str_field("m", "$.subtype")).alias("subtype"),
        of_message(str_field("m", "$.text")).alias("text"), of_message(F.to_json("m")).alias("payload"),
        of_message(F.to_json("m")).alias("event_payload"), of_message(count_field("m", "$.reply_count", None)).alias("reply_count"),
        of_message(str_field("m", "$.latest_reply")).alias("latest_reply")))


def all_rows(live: DataFrame | None = None, history_pages: DataFrame | None = None, reply_pages: DataFrame | None = None) -> DataFrame:
    """The feeds given, as one frame of feed rows; each may be a stream."""
    parts = [live_rows(live)] if live is not None else []
    parts += [page_rows(p, f) for p, f in ((history_pages, HISTORY), (reply_pages, REPLIES)) if p is not None]
    if not parts:
        raise ValueError("no feed given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
