"""Metadata responses (S5): workspace and channel names from lookup bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.json_fields import http_ok, is_object, json_type, str_field


def read_metadata(responses: DataFrame, body: str = "body", status: str = "status") -> DataFrame:
    """One lookup-log row per response (kind 'team' or 'channel').

    A team without a name, or with an empty one, is an error; a channel without a name is named by
    its id. Non-ok bodies and statuses outside 200-299 become errors (S6 rule). Output: workspace_id, channel_id, kind, ok,
    name, error, at.
    """
    v = F.try_parse_json(F.col(body))
    r = responses.withColumn("_v", v)
    okflag = F.coalesce((json_type("_v", "$.ok") == "BOOLEAN") & F.try_variant_get("_v", "$.ok", "boolean"), F.lit(False)) & http_ok(status)
    http_err = F.coalesce(F.when(is_object("_v"), str_field("_v", "$.error")),
                          F.concat(F.lit("HTTP "), F.col(status).cast("string")))
    team = F.nullif(str_field("_v", "$.team.name"), F.lit(""))
    chan = F.nullif(str_field("_v", "$.channel.name"), F.lit(""))
    name = F.when(F.col("kind") == "team", team).otherwise(F.coalesce(chan, F.col("channel_id")))
    error = (F.when(~okflag, F.concat(F.lit("lookup failed: "), http_err))
             .when((F.col("kind") == "team") & team.isNull(), F.lit("no team name")))
    return r.select("workspace_id", "channel_id", "kind", error.isNull().alias("ok"),
                    F.when(error.isNull(), name).alias("name"), error.alias("error"), "at")
