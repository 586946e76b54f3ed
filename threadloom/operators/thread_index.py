"""Thread index and reply planning.

Observations of roots (from history pages) and fetches of their replies are one log per root. One
window over the log in order of time gives every row the reply count last seen and the count that
was covered by the last fetch; the index and the plan are read off the rows. At one instant an
observation comes before a fetch, and ties are broken by the counts, so the answer does not depend
on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["workspace_id", "channel_id", "root_ts"]


def observations(history_items: DataFrame) -> DataFrame:
    """D8 input: root observations of history rows; rows carrying any thread_ts are skipped (Q5)."""
    extra = ["job_id"] if "job_id" in history_items.columns else []
    return history_items.where(F.col("thread_ts").isNull()).select(
        *extra, "workspace_id", "channel_id", F.col("message_ts").alias("root_ts"),
        F.coalesce("reply_count", F.lit(0)).cast("bigint").alias("reply_count"),
        F.col("latest_reply").alias("latest_reply_ts"), F.col("observed_at").alias("indexed_at"))


def _log(obs: DataFrame, fetches: DataFrame | None) -> DataFrame:
    """Observations (is_fetch 0) and fetches (1) with ``fetched``: the count covered by the last fetch up to the row."""
    if "job_id" not in obs.columns:
        obs = obs.withColumn("job_id", F.lit(None).cast("bigint"))
    rows = obs.select("job_id", *KEY, F.col("indexed_at").alias("at"), F.lit(0).alias("is_fetch"), "reply_count", "latest_reply_ts")
    if fetches is not None:
        rows = rows.unionByName(fetches.select(
            F.lit(None).cast("bigint").alias("job_id"), *KEY, F.col("fetched_at").alias("at"), F.lit(1).alias("is_fetch"),
            F.lit(None).cast("bigint").alias("reply_count"), F.lit(None).cast("string").alias("latest_reply_ts")))
    so_far = (Window.partitionBy(*KEY).orderBy("at", "is_fetch", "reply_count", "latest_reply_ts", "job_id")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = F.last("reply_count", ignorenulls=True).over(so_far)
    rows = rows.withColumn("_covers", F.when(F.col("is_fetch") == 1, seen))
    return rows.withColumn("fetched", F.last("_covers", ignorenulls=True).over(so_far)).drop("_covers")


def thread_index(obs: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """Index rows per observed root. A fetch of a root that was not observed before changes nothing."""
    last = F.struct("at", "is_fetch", "reply_count", "latest_reply_ts")
    seen = F.when(F.col("is_fetch") == 0, last)
    idx = _log(obs, fetches).groupBy(*KEY).agg(
        F.max(seen).alias("_last"), F.max_by("fetched", last).alias("_fetched"),
        F.max(F.when((F.col("is_fetch") == 1) & F.col("fetched").isNotNull(), F.col("at"))).alias("fetched_at"))
    return idx.where(F.col("_last").isNotNull()).select(
        *KEY, F.col("_last.reply_count").alias("observed_reply_count"), F.col("_last.latest_reply_ts").alias("latest_reply_ts"),
        F.col("_last.at").alias("indexed_at"), F.coalesce("_fetched", F.lit(0)).cast("bigint").alias("fetched_reply_count"), "fetched_at")


def open_log(log: DataFrame) -> DataFrame:
    """The rows of a log that its index rests on or that a later row can still bring into play, whatever its time.

    ``log``: KEY, is_fetch, reply_count, latest_reply_ts, at. Of each root these stay: the last fetch, the last observation
    that it covers, and every observation after it. An observation before the last covered one can neither be the last
    seen nor the last before a fetch again, because the time of the last fetch only grows. So the index of a log is the
    index of its open rows, and open rows may be merged with new rows in any order: ``open_log(open_log(a) + b)`` equals
    ``open_log(a + b)``. Equal rows count once. A missing ``at`` comes before all times, as in ``thread_index``.
    """
    fetch = F.col("is_fetch") == 1
    last = log.groupBy(*KEY).agg(F.count_if(fetch).alias("_fetches"), F.max(F.when(fetch, F.col("at"))).alias("_until"))
    keyed = last.select(*[F.col(k).alias(f"_{k}") for k in KEY], "_fetches", "_until")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    covered = (F.col("_fetches") > 0) & F.coalesce(F.col("at") <= F.col("_until"), F.col("at").isNull())
    seen = log.where(~fetch).join(keyed, same).withColumn("_covered", covered)
    value = ["at", "reply_count", "latest_reply_ts"]
    before = seen.where("_covered").groupBy(*KEY).agg(F.max(F.struct(*value)).alias("_last")).select(*KEY, "_last.*")
    after = seen.where(~F.col("_covered")).select(*KEY, *value).distinct()
    none = [F.lit(None).cast("bigint").alias("reply_count"), F.lit(None).cast("string").alias("latest_reply_ts")]
    out = ["is_fetch", *KEY, "reply_count", "latest_reply_ts", "at"]
    return (before.unionByName(after).withColumn("is_fetch", F.lit(0)).select(*out)
            .unionByName(last.where("_fetches > 0").select(F.lit(1).alias("is_fetch"), *KEY, *none, F.col("_until").alias("at")).select(*out)))


def stale_threads(index: DataFrame) -> DataFrame:
    """B1: roots whose observed reply count exceeds the fetched one."""
    return index.where(F.col("observed_reply_count") > F.col("fetched_reply_count"))


def plan_replies(obs_with_job: DataFrame, fetches: DataFrame, history_tasks: DataFrame) -> DataFrame:
    """Reply tasks: a root seen in a job's page with more replies than fetched by then.

    One task per (job, workspace, channel, root), with the window of the history task that saw it.
    ``history_tasks``: job_id, workspace_id, channel_id, oldest, latest.
    """
    asked = (_log(obs_with_job, fetches).where((F.col("is_fetch") == 0) & (F.col("reply_count") > F.coalesce("fetched", F.lit(0))))
             .select("job_id", *KEY).distinct())
    windows = history_tasks.groupBy("job_id", "workspace_id", "channel_id").agg(F.min("oldest").alias("oldest"), F.max("latest").alias("latest"))
    return asked.join(windows, ["job_id", "workspace_id", "channel_id"], "left").select(
        "job_id", *KEY, F.lit("replies").alias("phase"), "oldest", "latest")
