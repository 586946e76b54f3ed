"""Backlog plan (G14): the batch of every group when batches are fetched and acknowledged until none is left.

A batch takes groups in digest order while their cost stays within the budget; a group over the
budget is a batch of its own. That is a walk along one scope's groups, but no task walks: running
costs and limits, merged in one order, tell for every group where the next batch would begin if one began there, and the walk from
the first group is then found by doubling these jumps, in logarithmically many joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.digest import Grouped, _check_budget, ordered_groups
from threadloom.operators.scan import running_total
from threadloom.plans.stage import stage


def _next_starts(ordered: DataFrame, scope: list[str], budget: int) -> DataFrame:
    """For each group, the position of the first group that does not fit after it.

    A batch that begins at a group takes every group whose running cost is at most the group's limit. Running costs and
    limits are merged into one ordered stream; the running costs passed before a limit are the positions it covers, because
    positions are dense. The stream has two rows a group, whatever the budget.
    """
    ends = ordered.select(*scope, F.col("upto").alias("at"), F.lit(0).alias("is_limit"), "group_position")
    limits = ordered.select(*scope, (F.col("upto") - F.col("cost") + budget).alias("at"), F.lit(1).alias("is_limit"), "group_position")
    order = [F.col("at"), F.col("is_limit"), F.col("group_position")]
    merged = running_total(ends.unionByName(limits), scope, order, 1 - F.col("is_limit"), "covered")
    return merged.where("is_limit = 1").select(
        *scope, "group_position", (F.greatest("group_position", "covered") + 1).cast("bigint").alias("jump"))


def plan_batches(grouped: Grouped, budget: int, tiebreak: str = "event_sequence") -> DataFrame:
    """Scope, group_id, group_position, cost and ``batch_no`` (1-based) of every group."""
    _check_budget(budget)
    scope = grouped.scope
    ordered = ordered_groups(grouped, tiebreak).select(*scope, "group_id", "group_position", "cost")
    ordered = stage(running_total(ordered, scope, [F.col("group_position")], F.col("cost"), "upto"), "backlog")
    jumps = stage(_next_starts(ordered, scope, budget), "backlog-jumps")
    starts = stage(ordered.where("group_position = 1").select(*scope, "group_position"), "backlog-starts")
    known = starts.count()
    while True:
        # from every known start one jump further, then jumps of twice the length
        more = starts.join(jumps, [*scope, "group_position"]).select(*scope, F.col("jump").alias("group_position"))
        starts = stage(starts.unionByName(more).distinct(), "backlog-starts")
        now = starts.count()
        if now == known:
            break
        known = now
        onward = jumps.select(*scope, F.col("group_position").alias("jump"), F.col("jump").alias("further"))
        jumps = stage(jumps.join(onward, [*scope, "jump"]).select(*scope, "group_position", F.col("further").alias("jump")), "backlog-jumps")
    marked = ordered.join(starts.withColumn("_starts", F.lit(1)), [*scope, "group_position"], "left")
    return running_total(marked, scope, [F.col("group_position")], F.coalesce("_starts", F.lit(0)), "batch_no").select(
        *scope, "group_id", "group_position", "cost", "batch_no")
