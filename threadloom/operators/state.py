"""Latest-state tables from append logs (D6, D7, D10, D11) and the metadata-due test (M3).

Rows are never updated in place: every change is an appended log row and the
state is an aggregate per key (``max_by`` on the change time), so the log can be
replayed, compacted or read at any ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.inbox import as_column

METADATA_MAX_AGE_HOURS = 24
METADATA_RETRY_MINUTES = 15


def targets_state(registrations: DataFrame, toggles: DataFrame | None = None) -> DataFrame:
    """Observation targets.

    ``registrations``: workspace_id, channel_id, at (first live message of a channel or a
    manual add; a repeat only moves updated_at). ``toggles``: workspace_id, channel_id,
    enabled, at; they apply only to keys that exist (registered no later than the toggle).
    """
    keys = ["workspace_id", "channel_id"]
    reg = registrations.groupBy(*keys).agg(F.min("at").alias("created_at"), F.max("at").alias("_reg_at"))
    if toggles is None:
        return reg.select(*keys, F.lit(True).alias("enabled"), "created_at", F.col("_reg_at").alias("updated_at"))
    t = toggles.join(reg.select(*keys, "created_at"), keys).where(F.col("at") >= F.col("created_at"))
    tog = t.groupBy(*keys).agg(F.max_by("enabled", F.struct("at", "enabled")).alias("_enabled"), F.max("at").alias("_tog_at"))
    j = reg.join(tog, keys, "left")
    return j.select(*keys, F.coalesce("_enabled", F.lit(True)).alias("enabled"), "created_at",
                    F.greatest("_reg_at", F.coalesce("_tog_at", "_reg_at")).alias("updated_at"))


def metadata_state(log: DataFrame, keys: list[str], name_col: str) -> DataFrame:
    """Name state per key from a lookup log (ok, name, error, at).

    A success sets name, synced and attempted time and clears the error; a failure sets
    attempted time and error and keeps the earlier name.
    """
    ok = F.col("ok")
    return log.groupBy(*keys).agg(
        F.max_by("name", F.when(ok, F.struct("at", "name"))).alias(name_col),
        F.max(F.when(ok, F.col("at"))).alias("last_synced_at"),
        F.max("at").alias("last_attempted_at"),
        # at one instant a failure counts as the later of the two
        F.max_by(F.when(~ok, F.col("error")), F.struct("at", (~ok).alias("failed"), "error")).alias("last_error"),
    )


def split_lookups(lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workspace log, channel log) of lookups that carry both names.

    ``lookups``: workspace_id, channel_id, ok, workspace_name, channel_name, error, at. A failed lookup is
    recorded against the workspace and the channel alike.
    """
    ws = lookups.select("workspace_id", "ok", F.col("workspace_name").alias("name"), "error", "at")
    return ws, lookups.select("workspace_id", "channel_id", "ok", F.col("channel_name").alias("name"), "error", "at")


def metadata_due(targets: DataFrame, ws_meta: DataFrame, ch_meta: DataFrame, as_of,
                 max_age_hours: int = METADATA_MAX_AGE_HOURS) -> DataFrame:
    """M3: per target, whether the workspace name and the channel name need a lookup."""
    now = as_column(as_of)
    fresh_cut = now - F.make_interval(hours=F.lit(max_age_hours))
    retry_cut = now - F.make_interval(mins=F.lit(METADATA_RETRY_MINUTES))

    def recent(name_col: str) -> F.Column:
        return F.coalesce(
            (F.col(name_col).isNotNull() & (F.col("last_synced_at") > fresh_cut)) | (F.col("last_attempted_at") > retry_cut),
            F.lit(False))

    w = ws_meta.select("workspace_id", recent("workspace_name").alias("_ws_recent"))
    c = ch_meta.select("workspace_id", "channel_id", recent("channel_name").alias("_ch_recent"))
    j = (targets.select("workspace_id", "channel_id")
         .join(w, ["workspace_id"], "left").join(c, ["workspace_id", "channel_id"], "left"))
    return j.select("workspace_id", "channel_id",
                    (~F.coalesce("_ws_recent", F.lit(False))).alias("workspace_due"),
                    (~F.coalesce("_ch_recent", F.lit(False))).alias("channel_due"))
