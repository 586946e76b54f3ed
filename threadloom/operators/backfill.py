"""Backfill planning and progress.

Requests are checked first; tasks are planned per enabled target; task progress is an append log
reduced to the latest state per task, and a job's state follows from its tasks and its cancellation.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.inbox import as_column
from threadloom.operators.scan import ordinal

DONE = ("completed", "canceled")
JOBS = "job_id bigint, kind string, start_at timestamp, end_at timestamp"
TASKS = ("job_id bigint, workspace_id string, channel_id string, phase string, oldest timestamp, latest timestamp, "
         "kind string, start_at timestamp, end_at timestamp, task_no bigint")


def validate_window(requests: DataFrame, start: str = "start_text", end: str = "end_text") -> tuple[DataFrame, DataFrame]:
    """N18 over stored requests: (valid with ``start_at`` and ``end_at``, rejected with ``reason``).

    Both ends must be readable times and the start must come before the end.
    """
    t = requests.withColumn("start_at", F.expr(f"try_cast({start} AS timestamp)")).withColumn(
        "end_at", F.expr(f"try_cast({end} AS timestamp)"))
    reason = (F.when(F.col("start_at").isNull(), "unreadable start").when(F.col("end_at").isNull(), "unreadable end")
              .when(F.col("start_at") >= F.col("end_at"), "start not before end"))
    t = t.withColumn("reason", reason)
    return t.where(F.col("reason").isNull()).drop("reason"), t.where(F.col("reason").isNotNull())


def valid_jobs(jobs: Sequence[tuple]) -> tuple[list[tuple], list[tuple]]:
    """N18 for the requests of one call: (job_id, kind, start, end) split into (valid, rejected: start >= end)."""
    good = [j for j in jobs if _utc(j[2]) < _utc(j[3])]
    return good, [j for j in jobs if not _utc(j[2]) < _utc(j[3])]


def _utc(at: _dt.datetime) -> _dt.datetime:
    """Naive datetimes are UTC; others are converted."""
    return at if at.tzinfo is None else at.astimezone(_dt.timezone.utc).replace(tzinfo=None)


def plan_history(targets: DataFrame, jobs: Sequence[tuple], retention_days: int) -> DataFrame:
    """B2: one history task per enabled target per valid job; the scan covers [end - retention, end].

    The kind and the requested window stay on the task (Q7: the scan starts at the retention limit,
    whatever start was asked for). Tasks are numbered per job in target order. ``jobs`` are the requests
    of one call; each of them has a task for every target, which is the plan itself.
    """
    good, _ = valid_jobs(jobs)
    if not good:
        return targets.sparkSession.createDataFrame([], TASKS)
    asked = F.array(*[F.struct(F.lit(j[0]).cast("bigint").alias("job_id"), F.lit(j[1]).alias("kind"),
                               as_column(j[2]).alias("start_at"), as_column(j[3]).alias("end_at")) for j in good])
    t = targets.where("enabled").select("workspace_id", "channel_id", F.explode(asked).alias("j"))
    t = t.select("j.job_id", "workspace_id", "channel_id", F.lit("history").alias("phase"),
                 (F.col("j.end_at") - F.make_interval(days=F.lit(retention_days))).alias("oldest"),
                 F.col("j.end_at").alias("latest"), "j.kind", "j.start_at", "j.end_at")
    return ordinal(t, ["job_id"], [F.col("workspace_id"), F.col("channel_id")], "task_no")


def task_state(log: DataFrame) -> DataFrame:
    """Latest state per task from its log (task_id, at, seq, kind, cursor, error, not_before).

    created -> queued; claimed -> running (attempts + 1); page with cursor -> queued at the
    cursor; page without, or completed -> completed; error -> retry (not_before, last_error);
    cancel -> canceled only from queued or retry. A page clears the error. Events of one instant are
    ordered by ``seq``.
    """
    kind = F.col("kind")
    when = F.struct("at", "seq")
    page = kind.isin("page", "completed")
    eff = (F.when(kind == "created", "queued").when(kind == "claimed", "running")
           .when((kind == "page") & F.col("cursor").isNotNull(), "queued").when(page, "completed")
           .when(kind == "error", "retry"))
    steps = log.withColumn("_state", eff).withColumn("_when", when)
    agg = steps.groupBy("task_id").agg(
        F.max_by("_state", F.when(kind != "cancel", F.col("_when"))).alias("_last"),
        F.max(F.when(kind != "cancel", F.col("_when"))).alias("_last_at"),
        F.max(F.when(kind == "cancel", F.col("_when"))).alias("_cancel_at"),
        F.min(F.when(kind == "created", F.col("at"))).alias("created_at"),
        F.max(F.when(F.col("_state") == "completed", F.col("at"))).alias("_done_at"),
        F.count_if(kind == "claimed").alias("attempts"),
        F.max_by("cursor", F.when(kind == "page", F.col("_when"))).alias("cursor"),
        F.max(F.when(kind == "error", F.col("_when"))).alias("_err_at"),
        F.max(F.when(page, F.col("_when"))).alias("_page_at"),
        F.max_by("error", F.when(kind == "error", F.col("_when"))).alias("_err"),
        F.max_by("not_before", F.when(kind == "error", F.col("_when"))).alias("_nb"),
    )
    canceled = F.col("_cancel_at").isNotNull() & (F.col("_cancel_at") > F.col("_last_at")) & F.col("_last").isin("queued", "retry")
    state = F.when(canceled, F.lit("canceled")).otherwise(F.col("_last"))
    err_live = F.col("_err_at").isNotNull() & (F.col("_page_at").isNull() | (F.col("_err_at") > F.col("_page_at")))
    return agg.select("task_id", state.alias("state"), F.col("attempts").cast("bigint"), "cursor",
                      F.when(err_live, F.col("_err")).alias("last_error"),
                      F.when(state == "retry", F.col("_nb")).alias("not_before"), "created_at",
                      F.when(state == "completed", F.col("_done_at")).alias("completed_at"),
                      F.col("_err_at.at").alias("error_at"), F.col("_err").alias("any_error"))


def _per_job(tasks: DataFrame, states: DataFrame) -> DataFrame:
    t = tasks.select("task_id", "job_id", "workspace_id", "channel_id", "phase").join(states, "task_id", "left")
    return t.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_tasks"), F.count_if(~F.col("state").isin(*DONE)).alias("_open"),
        F.count_if(F.col("state") == "canceled").alias("_canceled"), F.max("attempts").alias("_attempts"),
        F.max("completed_at").alias("_done_at"), F.count_if(F.col("state") == "completed").alias("completed_tasks"),
        F.count_distinct(F.struct("workspace_id", "channel_id")).alias("channels"),
        F.count_if(F.col("phase") == "history").alias("history_tasks"), F.count_if(F.col("phase") == "replies").alias("reply_tasks"),
        F.max_by("any_error", F.struct("error_at", "any_error")).alias("last_error"))


def _with_state(jobs: DataFrame, tasks: DataFrame, states: DataFrame, cancels: DataFrame | None) -> DataFrame:
    j = jobs.join(_per_job(tasks, states), "job_id", "left")
    if cancels is None:
        j = j.withColumn("_cancel_at", F.lit(None).cast("timestamp"))
    else:
        j = j.join(cancels.groupBy("job_id").agg(F.max("at").alias("_cancel_at")), "job_id", "left")
    done = F.coalesce("_open", F.lit(0)) == 0
    finished = done & (F.col("_cancel_at").isNull() | (F.coalesce("_canceled", F.lit(0)) == 0)
                       | F.coalesce(F.col("_done_at") > F.col("_cancel_at"), F.lit(False)))
    state = (F.when(finished, "completed").when(F.col("_cancel_at").isNotNull(), "canceled")
             .when(F.coalesce("_attempts", F.lit(0)) > 0, "running").otherwise("queued"))
    return j.withColumn("state", state)


def job_state(jobs: DataFrame, tasks: DataFrame, states: DataFrame, cancels: DataFrame | None = None) -> DataFrame:
    """State of every accepted job.

    A job is completed once no task is outside completed and canceled and a task's completion made it so
    (a job without tasks at once). ``cancels`` (job_id, at) stop a job that is queued or running then: its
    waiting tasks are canceled, and it is canceled unless a task that was running completes it later. A
    job that was complete before stays so. Otherwise it is running once a task was attempted, else queued.
    """
    return _with_state(jobs.select("job_id"), tasks, states, cancels).select("job_id", "state")


def job_report(jobs: DataFrame, tasks: DataFrame, states: DataFrame, cancels: DataFrame | None = None, n: int = 20) -> DataFrame:
    """Per job its request, state, times, last error, channels and task counts; newest ``n`` jobs.

    The top-k is the feature. ``jobs``: job_id, kind, start_at, end_at, created_at. A job without tasks
    reports 0 tasks (Q9) and completes when it is created.
    """
    j = _with_state(jobs, tasks, states, cancels)
    counts = ["channels", "completed_tasks", "total_tasks", "history_tasks", "reply_tasks"]
    return (j.select("job_id", "kind", "state", "start_at", "end_at", "created_at",
                     F.when(F.col("state") == "completed", F.coalesce("_done_at", "created_at")).alias("completed_at"), "last_error",
                     *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
            .orderBy(F.col("job_id").desc()).limit(n))
