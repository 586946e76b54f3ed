"""Streaming ingest of live, history and reply feeds into one store (T1-T3, T5, T7, T8, S2, D1-D5), channel
windows (T4) and downtime gaps (T6).

Each micro-batch is parsed and landed once; every table is then derived from that landing:

* ``landed/batch=N``: the feed rows of the batch (``sources.feeds``), rejects and failed pages included;
* ``quarantine/batch=N``: rejected envelopes with the reason (N3);
* ``page_errors/batch=N``: pages that were not ok, with the error (S6);
* ``raw/received_date=D/batch=N``: one row per event id (D1), not stored before;
* ``messages/message_date=D/batch=N``: first arrival of each identity (D2) over all feeds, with ``event_sequence`` (D3);
* ``thread_log/batch=N``: roots seen in history pages and threads fetched (D8, D9);
* ``thread_state/root_date=D/batch=N``: of each root that the batch brought, the open rows of its log after the batch;
* ``target_log/batch=N``: first and last time a live channel was seen (T7);
* ``sequences/batch=N``: first sequence number and count of the batch.

A batch overwrites its own folders only, so a batch that is delivered again after a failure leaves
each row once. Nothing is dropped for being late: duplicates are found by joins with the stored dates that
the batch's rows lie in, not by a watermark. A batch reads its own folders by path and lists no folder of
another batch, but for the dates it is joined with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import message_instant, message_secs
from threadloom.operators import dedupe, inbox, thread_index
from threadloom.sources import envelopes as env
from threadloom.sources import feeds, history

RAW_HORIZON_DAYS = 7
ARRIVAL = feeds.ARRIVAL
MAX_DATES = 1000  # a batch with messages of more dates is joined with all stored identities instead
_MESSAGE = ("event_id string, workspace_id string, channel_id string, message_ts string, thread_ts string, user_id string, "
            "subtype string, text string, event_payload string")
SCHEMAS = {
    "landed": f"{feeds.ROW}, batch bigint",
    "quarantine": "envelope_id string, reject_reason string, received_at timestamp, payload string, batch bigint",
    "page_errors": "feed string, page_id string, workspace_id string, channel_id string, job_id bigint, root_ts string, "
                   "received_at timestamp, error string, batch bigint",
    "raw": "event_id string, workspace_id string, api_app_id string, callback_type string, event_type string, event_ts string, "
           "received_at timestamp, payload string, arrival bigint, received_date date, batch bigint",
    "messages": f"{_MESSAGE}, observed_at timestamp, event_sequence bigint, message_date date, batch bigint",
    "sequences": "first bigint, n bigint, batch bigint",
    "thread_log": "is_fetch int, job_id bigint, workspace_id string, channel_id string, root_ts string, reply_count bigint, "
                  "latest_reply_ts string, at timestamp, batch bigint",
    "thread_state": "is_fetch int, workspace_id string, channel_id string, root_ts string, reply_count bigint, "
                    "latest_reply_ts string, at timestamp, root_date date, batch bigint",
    "target_log": "workspace_id string, channel_id string, first_at timestamp, last_at timestamp, batch bigint",
    "windows": "workspace_id string, channel_id string, first_secs bigint, last_secs bigint, n_messages bigint, alive boolean, "
               "window_date date, batch bigint",
}


def envelope_stream(spark: SparkSession, path: str, max_files: int | None = None, fmt: str = "text") -> DataFrame:
    """S1 as a stream of landed files (see ``sources.envelopes.read_envelopes``)."""
    return env.read_envelopes(spark, path, streaming=True, fmt=fmt, options={"maxFilesPerTrigger": str(max_files)} if max_files else {})


def _path(spark: SparkSession, path: str):
    """The file system of a path and the path in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def _read(spark: SparkSession, root: str, name: str, paths: list[str]) -> DataFrame:
    """The rows of some folders of a stored table; empty if there are none."""
    if not paths:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).option("basePath", f"{root}/{name}").parquet(*paths)


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table; empty before its first batch."""
    path = f"{root}/{name}"
    return _read(spark, root, name, [path] if _exists(spark, path) else [])


def _own(spark: SparkSession, root: str, name: str, batch_id: int) -> DataFrame:
    """What a batch wrote to a table partitioned by batch alone; no other folder is listed."""
    path = f"{root}/{name}/batch={batch_id}"
    return _read(spark, root, name, [path] if _exists(spark, path) else []).drop("batch")


def stored_dates(spark: SparkSession, root: str, name: str) -> dict[str | None, str]:
    """Date folders of a table that is partitioned by a date first: date (None: unknown) to path, by one listing."""
    fs, target = _path(spark, f"{root}/{name}")
    found: dict[str | None, str] = {}
    if fs.exists(target):
        for entry in fs.listStatus(target):
            folder = entry.getPath().getName()
            if entry.isDirectory() and "=" in folder:
                day = folder.split("=", 1)[1]
                found[None if day == "__HIVE_DEFAULT_PARTITION__" else day] = f"{root}/{name}/{folder}"
    return found


def _dated(spark: SparkSession, root: str, name: str, batch_id: int, wanted: Callable[[str], bool]) -> DataFrame:
    """Rows that earlier batches stored under dates that are ``wanted`` or unknown."""
    paths = [p for d, p in stored_dates(spark, root, name).items() if d is None or wanted(d)]
    return _read(spark, root, name, paths).where(F.col("batch") < batch_id)


def _put(df: DataFrame, path: str, batch_id: int, *dates: str) -> None:
    """Write a batch's rows under its own partitions, replacing what an earlier try of the batch left there."""
    (df.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*dates, "batch").parquet(path))


def _next_sequence(spark: SparkSession, root: str, batch_id: int) -> int:
    """Sequence numbers given by all earlier batches; the batch before knows, if it is there."""
    spans = _own(spark, root, "sequences", batch_id - 1)
    last = spans.agg(F.max(F.col("first") + F.col("n")).alias("b")).first()["b"]
    if last is None:
        spans = _table(spark, root, "sequences").where(F.col("batch") < batch_id)
        last = spans.agg(F.max(F.col("first") + F.col("n")).alias("b")).first()["b"]
    return int(last or 0)


def _message_date(ts: str = "message_ts") -> Column:
    return F.coalesce(F.to_date(message_instant(ts)), F.lit("1970-01-01").cast("date"))


def _write_batch(root: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _put(batch if "feed" in batch.columns else feeds.live_rows(batch), f"{root}/landed", batch_id)
        landed = _own(spark, root, "landed", batch_id)
        is_live = F.col("feed") == feeds.LIVE
        seen = landed.agg(F.count_if(F.col("reject_reason").isNotNull()).alias("rejects"), F.count_if(~is_live).alias("of_pages"),
                          F.count_if(F.col("page_error").isNotNull()).alias("errors"),
                          F.min(F.to_date("received_at")).alias("oldest")).first()
        if seen["rejects"]:
            _put(landed.where(F.col("reject_reason").isNotNull()).select("envelope_id", "reject_reason", "received_at", "payload"),
                 f"{root}/quarantine", batch_id)
        if seen["errors"]:
            _put(landed.where(F.col("page_error").isNotNull()).select(
                "feed", "page_id", "workspace_id", "channel_id", "job_id", "root_ts", "received_at", F.col("page_error").alias("error")),
                f"{root}/page_errors", batch_id)
        if seen["of_pages"]:
            _put(_thread_rows(landed), f"{root}/thread_log", batch_id)
            _merge_threads(spark, root, batch_id)

        # First arrival of an event id in the batch, unless stored within the raw horizon
        good = landed.where(F.col("reject_reason").isNull() & F.col("event_id").isNotNull()).withColumn("received_date", F.to_date("received_at"))
        since = None if seen["oldest"] is None else str(seen["oldest"] - _days(RAW_HORIZON_DAYS))
        before = _dated(spark, root, "raw", batch_id, lambda d: since is None or d >= since)
        fresh = dedupe.dedupe_events(good, before, ARRIVAL)
        _put(fresh.select(*env.RAW_COLUMNS, "arrival", "received_date"), f"{root}/raw", batch_id, "received_date")

        # First arrival of a message identity over all feeds; an identity lies in one date partition
        extra = [c for c in ARRIVAL if c not in env.MESSAGE_COLUMNS]
        rows = env.normalise(fresh, "feed", *extra).withColumn("message_date", _message_date())
        days = landed.where(F.col("message_ts").isNotNull()).select(_message_date().alias("d")).distinct().limit(MAX_DATES + 1).collect()
        wanted = {str(r["d"]) for r in days}
        known = _dated(spark, root, "messages", batch_id, lambda d: len(wanted) > MAX_DATES or d in wanted)
        new = dedupe.dedupe_messages(rows, known, ARRIVAL)
        # D3: dense numbers after all earlier batches; D4: a page's messages oldest first
        base = _next_sequence(spark, root, batch_id)
        numbered = dedupe.assign_sequence(new, [F.col(c) for c in ARRIVAL], base)
        _put(numbered.drop("feed", *extra), f"{root}/messages", batch_id, "message_date")
        last = _written(spark, root, wanted, batch_id).agg(F.max("event_sequence").alias("m")).first()["m"]
        spans = spark.createDataFrame([(base, int(last or base) - base)], "first bigint, n bigint")
        _put(spans.coalesce(1), f"{root}/sequences", batch_id)
        # Channels seen live in this batch register as targets; a repeat moves only the last time
        _put(rows.where(is_live).groupBy("workspace_id", "channel_id").agg(
            F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at")), f"{root}/target_log", batch_id)
    return write


def _days(n: int):
    import datetime as dt
    return dt.timedelta(days=n)


def _written(spark: SparkSession, root: str, dates: set[str], batch_id: int) -> DataFrame:
    """The messages a batch has stored, read from its own folders."""
    if len(dates) > MAX_DATES:
        return _table(spark, root, "messages").where(F.col("batch") == batch_id)
    paths = [f"{root}/messages/message_date={d}/batch={batch_id}" for d in sorted(dates)]
    return _read(spark, root, "messages", [p for p in paths if _exists(spark, p)])


def _thread_rows(landed: DataFrame) -> DataFrame:
    """An observation for each root in a history page, a fetch for each reply page that was ok."""
    of_history = landed.where((F.col("feed") == feeds.HISTORY) & F.col("event_id").isNotNull())
    obs = thread_index.observations(of_history.withColumn("observed_at", F.col("received_at")))
    ok = (F.col("feed") == feeds.REPLIES) & F.col("page_error").isNull() & F.col("root_ts").isNotNull()
    got = landed.where(ok).select("page_id", "workspace_id", "channel_id", "root_ts", "received_at").distinct()
    return obs.select(F.lit(0).alias("is_fetch"), "job_id", *thread_index.KEY, "reply_count", "latest_reply_ts", F.col("indexed_at").alias("at")
                      ).unionByName(got.select(F.lit(1).alias("is_fetch"), F.lit(None).cast("bigint").alias("job_id"), *thread_index.KEY,
                                               F.lit(None).cast("bigint").alias("reply_count"), F.lit(None).cast("string").alias("latest_reply_ts"),
                                               F.col("received_at").alias("at")))


def _latest_threads(versions: DataFrame) -> DataFrame:
    """Of each root the open rows that the last of its batches wrote."""
    last = versions.groupBy(*thread_index.KEY).agg(F.max("batch").alias("_batch"))
    last = last.select(*[F.col(k).alias(f"_{k}") for k in thread_index.KEY], "_batch")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in thread_index.KEY] + [F.col("batch") == F.col("_batch")]
    return versions.join(last, same, "left_semi").drop("batch", "root_date")


def _merge_threads(spark: SparkSession, root: str, batch_id: int) -> None:
    """Merge the thread rows of a batch with the open rows of their roots. Open rows are stored under the date of the root, so
    only the dates of the batch's roots are read, and only the batch's roots are written."""
    own = _own(spark, root, "thread_log", batch_id).drop("job_id")
    listed = own.select(_message_date("root_ts").alias("d")).distinct().limit(MAX_DATES + 1).collect()
    wanted = {str(r["d"]) for r in listed}
    stored = _dated(spark, root, "thread_state", batch_id, lambda d: len(wanted) > MAX_DATES or d in wanted)
    touched = own.select(*[F.col(k).alias(f"_{k}") for k in thread_index.KEY]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in thread_index.KEY]
    old = _latest_threads(stored.join(touched, same, "left_semi"))
    merged = thread_index.open_log(old.unionByName(own))
    _put(merged.withColumn("root_date", _message_date("root_ts")), f"{root}/thread_state", batch_id, "root_date")


def start_store(rows: DataFrame, root: str, checkpoint: str, available_now: bool = True):
    """Land, validate, dedupe, number and persist a stream of feed rows (``feeds.all_rows``) under ``root``.

    The feeds of one store go through one stream, so one identity check and one sequence hold over all of them. A batch
    comes after all batches before it; inside a batch, rows come in the order of ``feeds.ARRIVAL``.
    """
    writer = rows.writeStream.foreachBatch(_write_batch(root)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_ingest(spark: SparkSession, source: DataFrame, root: str, checkpoint: str, available_now: bool = True):
    """T1 for live envelopes alone."""
    return start_store(feeds.all_rows(live=source), root, checkpoint, available_now)


def page_stream(spark: SparkSession, path: str, max_files: int | None = None, fmt: str = "json") -> DataFrame:
    """S3, S4 as a stream of landed pages, rows of ``history.PAGE_SCHEMA``."""
    reader = spark.readStream.schema(history.PAGE_SCHEMA).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def read_page_errors(spark: SparkSession, root: str) -> DataFrame:
    """Failed pages of all batches."""
    return _table(spark, root, "page_errors").drop("batch")


def read_thread_index(spark: SparkSession, root: str) -> DataFrame:
    """The thread index of what history and reply pages brought, from the open rows of each root."""
    log = _latest_threads(_table(spark, root, "thread_state"))
    obs = log.where("is_fetch = 0").withColumnRenamed("at", "indexed_at")
    return thread_index.thread_index(obs, log.where("is_fetch = 1").select(*thread_index.KEY, F.col("at").alias("fetched_at")))


def read_messages(spark: SparkSession, root: str) -> DataFrame:
    """Stored messages; identities and sequence numbers are unique as written (T5: in order of arrival)."""
    return _table(spark, root, "messages").drop("batch", "message_date")


def read_changed(spark: SparkSession, root: str, after: int, as_of, settle_seconds: int = inbox.DEFAULT_SETTLE_SECS) -> DataFrame:
    """Settled messages after sequence ``after``; batches that end before it are not read.

    The settle delay is a filter on arrival at read time, so an unsettled message is returned later, never lost.
    """
    spans = _table(spark, root, "sequences")
    low = spans.where(F.col("first") + F.col("n") > after).agg(F.min("batch").alias("b")).first()["b"]
    rows = _table(spark, root, "messages")
    rows = rows.where(F.col("batch") >= low) if low is not None else rows.where(F.lit(False))
    rows = rows.where(F.col("event_sequence") > after).drop("batch", "message_date")
    return inbox.settled(rows, as_of, settle_seconds)


def read_targets(spark: SparkSession, root: str) -> DataFrame:
    """Registrations for ``state.targets_state``: a row for the first and for the last time of each batch."""
    log = _table(spark, root, "target_log")
    return log.select("workspace_id", "channel_id", F.explode(F.array("first_at", "last_at")).alias("at"))


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """Rejected envelopes of all batches."""
    return _table(spark, root, "quarantine").drop("batch")


# ---------------------------------------------------------------- T4, channel windows


CHANNEL = ["workspace_id", "channel_id"]


def merge_spans(spans: DataFrame, gap_seconds: int) -> DataFrame:
    """Number (``span_no``, per channel) the runs of spans whose ends lie within ``gap_seconds`` of each other."""
    w = Window.partitionBy(*CHANNEL).orderBy("first_secs", "last_secs")
    reach = spans.withColumn("_reach", F.max("last_secs").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("_reach").isNull() | (F.col("first_secs") - F.col("_reach") > gap_seconds)
    return reach.withColumn("span_no", F.sum(new.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_reach")


def _date(secs: Column) -> Column:
    return F.to_date(F.timestamp_seconds(secs))


def _each_date(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    return df.withColumn("window_date", F.explode(F.sequence(_date(lo), _date(hi))))


def _latest_windows(versions: DataFrame) -> DataFrame:
    """Of each channel and first second the last version, unless a merge has removed it."""
    last = versions.groupBy(*CHANNEL, "first_secs").agg(F.max_by(F.struct("last_secs", "n_messages", "alive"), "batch").alias("v"))
    return last.where("v.alive").select(*CHANNEL, "first_secs", "v.last_secs", "v.n_messages")


def near_windows(spark: SparkSession, root: str, own: DataFrame, gap_seconds: int, batch_id: int) -> DataFrame:
    """Stored windows of the channels and dates that ``own`` spans, widened by the gap, lie in. A window is stored under every date
    it covers, so each window within the gap of a span is among them; other dates are not read."""
    lo, hi = F.col("first_secs") - gap_seconds, F.col("last_secs") + gap_seconds
    days = _each_date(own.select(*CHANNEL, "first_secs", "last_secs"), lo, hi).select(*CHANNEL, "window_date").distinct()
    listed = days.select("window_date").distinct().limit(MAX_DATES + 1).collect()
    wanted = {str(r["window_date"]) for r in listed}
    stored = _dated(spark, root, "windows", batch_id, lambda d: len(wanted) > MAX_DATES or d in wanted)
    same = [stored[c].eqNullSafe(days[c]) for c in CHANNEL] + [stored["window_date"] == days["window_date"]]
    return _latest_windows(stored.join(days, same, "left_semi"))


def own_spans(messages: DataFrame, gap_seconds: int) -> DataFrame:
    """Windows of a batch's standalone messages alone. Messages are counted in time buckets of the gap's width first
    (map-side): no window ends inside a bucket, so a busy channel is a row per bucket before it meets in one place."""
    rows = messages.select(*CHANNEL, message_secs("message_ts").alias("_s"))
    buckets = rows.groupBy(*CHANNEL, F.floor(F.col("_s") / F.lit(gap_seconds)).alias("_b")).agg(
        F.min("_s").alias("first_secs"), F.max("_s").alias("last_secs"), F.count(F.lit(1)).alias("n_messages"))
    return merge_spans(buckets.drop("_b"), gap_seconds).groupBy(*CHANNEL, "span_no").agg(
        F.min("first_secs").alias("first_secs"), F.max("last_secs").alias("last_secs"), F.sum("n_messages").alias("n_messages")).drop("span_no")


def _write_windows(root: str, gap_seconds: int):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _put(own_spans(batch, gap_seconds), f"{root}/spans", batch_id)
        path = f"{root}/spans/batch={batch_id}"
        if not _exists(spark, path):
            return
        own = spark.read.schema(SPANS).parquet(path)
        near = near_windows(spark, root, own, gap_seconds, batch_id)
        both = own.withColumn("own", F.lit(True)).unionByName(near.withColumn("own", F.lit(False)))
        runs = merge_spans(both, gap_seconds).groupBy(*CHANNEL, "span_no").agg(
            F.min("first_secs").alias("first_secs"), F.max("last_secs").alias("last_secs"), F.sum("n_messages").alias("n_messages"),
            F.bool_or("own").alias("own"), F.collect_list(F.when(~F.col("own"), F.struct("first_secs", "last_secs"))).alias("olds"))
        kept = F.array(F.struct("first_secs", "last_secs", "n_messages", F.lit(True).alias("alive")))
        gone = F.transform(F.filter("olds", lambda o: o["first_secs"] != F.col("first_secs")), lambda o: F.struct(
            o["first_secs"].alias("first_secs"), o["last_secs"].alias("last_secs"), F.lit(0).cast("bigint").alias("n_messages"), F.lit(False).alias("alive")))
        rows = runs.where("own").select(*CHANNEL, F.explode(F.concat(kept, gone)).alias("w")).select(*CHANNEL, "w.*")
        _put(_each_date(rows, F.col("first_secs"), F.col("last_secs")), f"{root}/windows", batch_id, "window_date")
    return write


SPANS = "workspace_id string, channel_id string, first_secs bigint, last_secs bigint, n_messages bigint"


def start_windows(stream: DataFrame, gap_seconds: int, root: str, checkpoint: str):
    """T4: channel windows of a stream of standalone messages (each delivered once, as ``read_messages`` has them).

    A batch's messages become spans, the spans meet the stored windows of their channels and dates, and those within
    the gap merge; a window is never split, because a message never goes. Messages are not read again, nor are windows
    of other dates. The result does not depend on how messages fall into batches, late and reversed ones included.
    An empty ``thread_ts`` counts as none; a time that cannot be read is second 0; null channels are a channel.
    """
    standalone = F.nullif(F.col("thread_ts"), F.lit("")).isNull()
    return (stream.where(standalone).select(*CHANNEL, "message_ts").writeStream.foreachBatch(_write_windows(root, gap_seconds))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_windows(spark: SparkSession, root: str) -> DataFrame:
    """The windows of all channels, open ones included: first second, number of messages and last second."""
    rows = _table(spark, root, "windows").where(F.col("window_date") == _date(F.col("first_secs")))
    return _latest_windows(rows).select(*CHANNEL, "first_secs", "n_messages", "last_secs")


# ---------------------------------------------------------------- T6, downtime gaps


GAP_STATE = "last_disconnect bigint, last_event bigint, last_connect bigint"
GAPS = "source bigint, start_us bigint, end_us bigint"


def stream_gaps(log: DataFrame, min_gap_seconds: int = 300) -> DataFrame:
    """B7 over a stream of lifecycle rows (source, at, kind, seq), with state per source.

    A batch's rows of a source are put in order of (at, seq) in memory, so a batch must be bounded per source; the state is
    three times per source, each the latest of its kind. A row that comes in a later batch than a row after it moves no time
    back, and a connect that is late is compared with the times known by then.
    """
    import pandas as pd

    def step(key, frames, state):
        held = list(state.get) if state.exists else [None, None, None]
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["at_us", "seq"])
        out = []
        for at, kind in zip(rows["at_us"].tolist(), rows["kind"].tolist()):
            if kind == "connected":
                start = next((x for x in held if x is not None), None)
                if start is not None and at - start >= min_gap_seconds * 1_000_000:
                    out.append((int(key[0]), int(start), int(at)))
            slot = {"disconnected": 0, "event": 1, "connected": 2}[kind]
            held[slot] = at if held[slot] is None else max(held[slot], at)
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=["source", "start_us", "end_us"]).astype("int64").drop_duplicates()

    rows = log.select("source", F.unix_micros("at").alias("at_us"), "kind", "seq")
    return rows.groupBy("source").applyInPandasWithState(step, GAPS, GAP_STATE, "append", "NoTimeout")

