"""Deduplication and sequencing (D1-D5): first writer wins, dense arrival sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.scan import ordinal


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Live, history and thread feed rows in one frame (each carries callback_type)."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order`` (row_number = 1; planned as a group limit of 1)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedupe_events(feed: DataFrame, existing: DataFrame | None = None, order: Sequence[Column | str] = ("arrival",)) -> DataFrame:
    """One row per event_id, the first to arrive, and none already stored."""
    first = first_per_key(feed, ["event_id"], [F.col(o) if isinstance(o, str) else o for o in order])
    if existing is not None:
        first = first.join(existing.select("event_id"), ["event_id"], "left_anti")
    return first


def dedupe_messages(rows: DataFrame, existing: DataFrame | None = None,
                    order: Sequence[Column | str] = ("event_sequence",)) -> DataFrame:
    """Insert-if-absent by message identity (workspace, channel, message_ts), first wins
    even across different event ids."""
    ident = ["workspace_id", "channel_id", "message_ts"]
    first = first_per_key(rows, ident, [F.col(o) if isinstance(o, str) else o for o in order])
    if existing is not None:
        first = first.join(existing.select(*ident), ident, "left_anti")
    return first


def assign_sequence(rows: DataFrame, order: Sequence[Column], base: int | Column = 0, out: str = "event_sequence") -> DataFrame:
    """D3: dense sequence numbers ``base + 1, base + 2, ...`` in ``order``.

    Two passes over range slices (per-slice counts -> offsets), never one unpartitioned
    window. ``order`` must be unique and stable (for pages: D4's numeric ts, then id).
    """
    ranked = ordinal(rows.withColumn("_all", F.lit(0)), ["_all"], order, "_pos").drop("_all")
    b = base if isinstance(base, Column) else F.lit(base)
    return ranked.withColumn(out, (b + F.col("_pos")).cast("bigint")).drop("_pos")
