"""Stored acknowledgements and expiry on disk (R1-R4) for the tables of ``streaming.ingest``.

A purge works on folders: a folder whose rows are all expired is deleted, one with some expired rows is written again
without them, and one with none is left alone. Expired rows can only lie under dates up to the cutoff, so later dates
are read for the times and threads of their messages at most.

What a purge will do to a table is first written down below ``purging/<table>``: the rows to keep, then the folders. A purge that
was interrupted is finished from there by the next one, so no kept row is ever only in memory, and a purge may be repeated.
Ingest must not run into the same folders meanwhile (one writer for each store).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import retention
from threadloom.streaming import ingest

FOLDERS = {"raw": ["received_date", "batch"], "messages": ["message_date", "batch"], "acks": ["message_date", "batch"],
           "thread_log": ["batch"], "thread_state": ["root_date", "batch"]}
ingest.SCHEMAS["acks"] = "consumer_id string, event_id string, acknowledged_at timestamp, message_date date, batch bigint"


def append_acks(spark: SparkSession, root: str, acks: DataFrame, batch_id: int) -> None:
    """Store the acknowledgements (consumer_id, event_id, acknowledged_at) of a batch under the date of their message.

    The first acknowledgement of a consumer and message stays, repeats change nothing, and a batch delivered again replaces
    its own rows. Acknowledgements of messages that are not stored are not taken.
    """
    known = ingest._table(spark, root, "messages").select("event_id", "message_date")
    first = acks.groupBy("consumer_id", "event_id").agg(F.min("acknowledged_at").alias("acknowledged_at"))
    before = ingest._table(spark, root, "acks").where(F.col("batch") < batch_id).select("consumer_id", "event_id")
    fresh = first.join(before, ["consumer_id", "event_id"], "left_anti").join(known, "event_id")
    ingest._put(fresh.select("consumer_id", "event_id", "acknowledged_at", "message_date"), f"{root}/acks", batch_id, "message_date")


def read_acks(spark: SparkSession, root: str) -> DataFrame:
    """Stored acknowledgements, one a consumer and message."""
    return ingest._table(spark, root, "acks").drop("batch", "message_date")


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = ingest._path(spark, path)
    fs.delete(target, True)


def _folder(root: str, name: str, row) -> str:
    return "/".join([f"{root}/{name}", *[f"{p}={row[p]}" for p in FOLDERS[name]]])


def _finish(spark: SparkSession, root: str, name: str) -> None:
    """Carry out what is written down for a table, if it is written down whole; then forget it."""
    journal = f"{root}/purging/{name}"
    if ingest._exists(spark, f"{journal}/folders/_SUCCESS"):
        rows = spark.read.parquet(f"{journal}/folders").collect()  # one row for each folder that changes
        for row in rows:
            if not row["kept"]:
                path = _folder(root, name, row)
                _delete(spark, path)
                fs, above = ingest._path(spark, path.rsplit("/", 1)[0])
                if len(FOLDERS[name]) > 1 and fs.exists(above) and not fs.listStatus(above):
                    fs.delete(above, True)
        if any(row["kept"] for row in rows):
            (spark.read.schema(ingest.SCHEMAS[name]).parquet(f"{journal}/rows").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS[name]).parquet(f"{root}/{name}"))
    _delete(spark, journal)


def _keep(spark: SparkSession, root: str, name: str, stored: DataFrame, kept: DataFrame) -> None:
    """Replace ``stored``, the rows of whole folders, by ``kept``, some of them; folders that lose nothing are not touched."""
    parts = FOLDERS[name]
    n = stored.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
    left = kept.groupBy(*parts).agg(F.count(F.lit(1)).alias("kept"))
    changed = (n.join(left, parts, "left").withColumn("kept", F.coalesce("kept", F.lit(0))).where("kept < n").select(*parts, "kept"))
    changed = spark.createDataFrame(changed.collect(), changed.schema)  # no more rows than the store has folders
    journal = f"{root}/purging/{name}"
    if changed.isEmpty():
        return
    again = kept.select(*stored.columns).join(changed.where("kept > 0").select(*parts), parts, "left_semi")
    again.write.mode("overwrite").parquet(f"{journal}/rows")
    changed.coalesce(1).write.mode("overwrite").parquet(f"{journal}/folders")
    _finish(spark, root, name)


def _upto(spark: SparkSession, root: str, name: str, day: str) -> DataFrame:
    """The rows of a table under dates up to ``day``; other date folders are not read."""
    return ingest._read(spark, root, name, [p for d, p in ingest.stored_dates(spark, root, name).items() if d is not None and d <= day])


def purge_store(spark: SparkSession, root: str, as_of: dt.datetime, raw_days: int = retention.RAW_RETENTION_DAYS,
                message_days: int = retention.MESSAGE_RETENTION_DAYS) -> None:
    """R1-R4 on disk: expired raw events, expired messages (a root stays while a reply to it is recent), thread-index entries
    whose root is gone, and acknowledgements whose message is gone.

    ``as_of`` without a zone is UTC. Rows without an arrival time, and messages whose time cannot be read, never expire.
    """
    for name in FOLDERS:
        _finish(spark, root, name)
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    raw_day = str((as_of - dt.timedelta(days=raw_days)).date())
    raw = _upto(spark, root, "raw", raw_day)
    _keep(spark, root, "raw", raw, retention.retain_raw(raw, as_of, raw_days))

    day = str((as_of - dt.timedelta(days=message_days)).date())
    old = _upto(spark, root, "messages", day)
    stays = retention.retain_messages(ingest._table(spark, root, "messages"), as_of, message_days)
    _keep(spark, root, "messages", old, stays.where(F.col("message_date") <= F.lit(day).cast("date")))

    left = _upto(spark, root, "messages", day).select("event_id")
    acks = _upto(spark, root, "acks", day)
    _keep(spark, root, "acks", acks, retention.retain_acks(acks, left))
    log = ingest._table(spark, root, "thread_log")
    _keep(spark, root, "thread_log", log, retention.retain_index(log, ingest._table(spark, root, "messages")))
    # a root lies under the date of its message, so later dates keep all their roots
    threads = _upto(spark, root, "thread_state", day)
    _keep(spark, root, "thread_state", threads, retention.retain_index(threads, _upto(spark, root, "messages", day)))
