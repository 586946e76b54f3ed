"""History and reply pages (S3, S4, S6) and their message rows.

A page is one JSON response body per row with the task's workspace and channel (and,
for reply pages, ``root_ts``). ``variant_explode`` turns the messages array into rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.json_fields import count_field, http_ok, is_object, json_type, str_field

PAGE_SCHEMA = ("page_id string, workspace_id string, channel_id string, root_ts string, job_id bigint, body string, "
               "status int, fetched_at timestamp")
HISTORY_CALLBACK = "history_backfill"
THREAD_CALLBACK = "thread_backfill"


def _ok(body: str) -> F.Column:
    return F.coalesce(json_type(body, "$.ok") == "BOOLEAN", F.lit(False)) & F.coalesce(
        F.try_variant_get(F.col(body), "$.ok", "boolean"), F.lit(False))


def parse_pages(pages: DataFrame, body: str = "body", status: str = "status") -> DataFrame:
    """Parse page bodies; adds ``page`` (variant), ``ok`` and ``next_cursor`` (empty -> null).

    A page is ok when its body says so and its HTTP status, if there is one, is 200 to 299.
    """
    p = pages.withColumn("page", F.try_parse_json(F.col(body)))
    cursor = str_field("page", "$.response_metadata.next_cursor")
    answered = http_ok(status) if status in pages.columns else F.lit(True)
    return p.withColumn("ok", F.coalesce(F.when(is_object("page"), _ok("page")), F.lit(False)) & answered).withColumn(
        "next_cursor", F.when(is_object("page", "$.response_metadata") & (cursor != ""), cursor))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON object a line with the columns of PAGE_SCHEMA (``root_ts`` on reply pages)."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def reply_messages(items: DataFrame) -> DataFrame:
    """Items of reply pages that belong to the thread asked for: the root itself or a reply to it."""
    return history_messages(items).where(in_thread())


def in_thread() -> F.Column:
    """The item is the thread's root or a reply to it."""
    own = (str_field("m", "$.ts") == F.col("root_ts")) | (str_field("m", "$.thread_ts") == F.col("root_ts"))
    return F.coalesce(F.col("root_ts").isNotNull() & own, F.lit(False))


def page_error(status: str = "status") -> F.Column:
    """The error text of a page that is not ok, or ``HTTP <status>``."""
    err = F.when(is_object("page"), str_field("page", "$.error"))
    return F.coalesce(err, F.concat(F.lit("HTTP "), F.col(status).cast("string")))


def page_errors(parsed: DataFrame, status: str = "status") -> DataFrame:
    """Pages that are not ok, with the error text or ``HTTP <status>``."""
    return parsed.where(~F.col("ok")).select(
        *[c for c in parsed.columns if c not in ("page", "ok", "next_cursor")], page_error(status).alias("error"))


def page_messages(parsed: DataFrame) -> DataFrame:
    """Message objects with a string ``ts`` of ok pages, one row per message, with
    its position in the page (``item_no``)."""
    ok = parsed.where(F.col("ok"))
    items = ok.select("*", F.posexplode(F.try_variant_get("page", "$.messages", "array<variant>")).alias("item_no", "m"))
    return items.where(is_object("m") & str_field("m", "$.ts").isNotNull()).drop("page")


def history_messages(items: DataFrame) -> DataFrame:
    """Keep items whose type is absent, empty or ``message``."""
    return items.where(is_history_item())


def is_history_item() -> F.Column:
    """The item's type is absent, empty or ``message``."""
    kind = json_type("m", "$.type")
    t = str_field("m", "$.type")
    return F.coalesce(kind.isNull() | (kind == "NULL") | t.isin("", "message"), F.lit(False))


def history_event_id(workspace: str = "workspace_id", channel: str = "channel_id", ts: F.Column | None = None) -> F.Column:
    """Synthetic delivery id ``history:<workspace>:<channel>:<ts>``."""
    return F.concat_ws(":", F.lit("history"), F.col(workspace), F.col(channel),
                       ts if ts is not None else str_field("m", "$.ts"))


def history_rows(items: DataFrame, callback: str, observed_at: str = "fetched_at", extra=()) -> DataFrame:
    """Message rows of history or reply items (feed rows for D1/D2); ``extra`` columns pass through."""
    return items.select(*extra,
        history_event_id().alias("event_id"), "workspace_id", "channel_id",
        str_field("m", "$.ts").alias("message_ts"), str_field("m", "$.thread_ts").alias("thread_ts"),
        str_field("m", "$.user").alias("user_id"), str_field("m", "$.subtype").alias("subtype"),
        str_field("m", "$.text").alias("text"), F.to_json("m").alias("event_payload"),
        F.col(observed_at).alias("observed_at"), F.lit(callback).alias("callback_type"),
        count_field("m", "$.reply_count", None).alias("reply_count"),
        str_field("m", "$.latest_reply").alias("latest_reply"),
        F.try_variant_get("m", "$.ts", "decimal(20,6)").alias("ts_num"),
    )
