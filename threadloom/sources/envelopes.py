"""Live event envelopes (S1) and their validation and normalisation.

Envelopes arrive as one JSON document per line. A document is parsed to VARIANT once;
every field is then read with a check of its JSON type, so a number is never mistaken for
a string, and later steps filter plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.json_fields import is_object, str_field

# A row of landed data: the line, when it arrived, and its place in the order of arrival.
LANDED = "body string, received_at timestamp, arrival bigint"


def read_envelopes(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "text",
                   options: dict | None = None) -> DataFrame:
    """Usable envelopes below ``path``, as a batch or a stream.

    ``text``: one envelope a line; a line arrives when its file does. ``parquet`` and ``json``: rows of
    LANDED, for landings that keep the time and order of arrival themselves.
    """
    reader = (spark.readStream if streaming else spark.read).options(**(options or {}))
    if fmt == "text":
        lines = reader.format("text").load(path).select(
            F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("received_at"),
            F.lit(None).cast("bigint").alias("arrival"))
    else:
        lines = reader.schema(LANDED).format(fmt).load(path)
    return envelope_payloads(lines)


def _once(df: DataFrame, fields: dict[str, Column], keep: list[str]) -> DataFrame:
    """Evaluate ``fields`` once a row, whatever is filtered or selected later.

    The generator is a barrier: predicates over its output cannot be rewritten into its input,
    where each would parse the document again.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])))
    return df.select(*keep, made.alias("_f")).select(*keep, "_f.*")


def envelope_payloads(lines: DataFrame, body: str = "body") -> DataFrame:
    """One row of typed fields for each ``events_api`` document whose payload is an object.

    ``event_type`` and the message fields are null when ``event`` is no object (N4).
    """
    keep = [c for c in lines.columns if c != body]
    env = lines.withColumn("_env", F.try_parse_json(F.col(body)))
    payload = F.try_variant_get("_env", "$.payload", "variant")
    event = F.when(is_object("_env", "$.payload.event"), F.try_variant_get("_env", "$.payload.event", "variant"))

    def at(path: str) -> Column:
        return str_field("_env", f"$.payload.{path}")

    def inside(name: str) -> Column:
        return F.when(is_object("_env", "$.payload.event"), at(f"event.{name}"))

    usable = (str_field("_env", "$.type") == "events_api") & is_object("_env", "$.payload")
    fields = {
        "_usable": F.coalesce(usable, F.lit(False)), "envelope_id": str_field("_env", "$.envelope_id"),
        "event_id": at("event_id"), "workspace_id": at("team_id"), "api_app_id": at("api_app_id"), "callback_type": at("type"),
        "event_type": inside("type"), "event_ts": inside("event_ts"), "channel_id": inside("channel"), "message_ts": inside("ts"),
        "thread_ts": inside("thread_ts"), "user_id": inside("user"), "subtype": inside("subtype"), "text": inside("text"),
        "payload": F.to_json(payload), "event_payload": F.to_json(event),
    }
    return _once(env, fields, keep).where("_usable").drop("_usable")


def validate(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads need string event_id, team_id and type. Returns (good, rejected with reason)."""
    tagged = with_reason(payloads)
    return tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"), tagged.where(
        F.col("reject_reason").isNotNull())


def with_reason(payloads: DataFrame) -> DataFrame:
    """Add ``reject_reason``, null for a valid payload."""
    def missing(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")) == ""

    reason = (F.when(missing("event_id"), "missing event_id").when(missing("workspace_id"), "missing team_id")
              .when(missing("callback_type"), "missing type"))
    return payloads.withColumn("reject_reason", reason)


RAW_COLUMNS = ["event_id", "workspace_id", "api_app_id", "callback_type", "event_type", "event_ts", "received_at", "payload"]
MESSAGE_COLUMNS = ["event_id", "workspace_id", "channel_id", "message_ts", "thread_ts", "user_id", "subtype", "text",
                   "event_payload"]


def is_message() -> Column:
    """Event type ``message`` with string channel and string ts."""
    return (F.col("event_type") == "message") & F.col("channel_id").isNotNull() & F.col("message_ts").isNotNull()


def normalise(raw: DataFrame, *extra: str) -> DataFrame:
    """Message rows from raw events that pass N5 (event_sequence assigned later, D3)."""
    return raw.where(is_message()).select(*MESSAGE_COLUMNS, F.col("received_at").alias("observed_at"), *extra)
