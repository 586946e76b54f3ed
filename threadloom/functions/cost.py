"""Digest projection and cost (N12, N13) and the segment cost used by G8/G10.

The cost of a message is the UTF-8 byte length of its projected JSON object
``{"eventId","messageTs","userId","subtype","text"[,"textContinues"]}`` with nulls
written out, and never below MIN_COST.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the digest contract.
MIN_COST = 24
MIN_BUDGET = 128
MAX_BUDGET = 100000
# Bytes added by the key of an optional continuation offset: `,"textContinues":` is 17
# bytes, followed by the decimal digits of the offset.
CONTINUES_KEY_BYTES = 17

_JSON_OPTS = {"ignoreNullFields": "false"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digest_message(text: Column | str | None = None, text_continues: Column | None = None) -> Column:
    """The five-field digest projection of a message row (raw payload never included)."""
    fields = [
        F.col("event_id").alias("eventId"),
        F.col("message_ts").alias("messageTs"),
        F.col("user_id").alias("userId"),
        F.col("subtype").alias("subtype"),
        (F.col("text") if text is None else _col(text)).alias("text"),
    ]
    if text_continues is not None:
        fields.append(text_continues.alias("textContinues"))
    return F.struct(*fields)


def projected_bytes(projection: Column) -> Column:
    """UTF-8 bytes of the projection as compact JSON with null fields written."""
    return F.octet_length(F.to_json(projection, _JSON_OPTS)).cast("bigint")


def message_cost(text: Column | str | None = None) -> Column:
    """``max(24, bytes of the projected JSON)`` for the current row."""
    return F.greatest(F.lit(MIN_COST).cast("bigint"), projected_bytes(digest_message(text)))
