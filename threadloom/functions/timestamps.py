"""Message-time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message_secs(ts: Column | str) -> Column:
    """Whole seconds of a message timestamp text; unparsable -> 0.

    The digest compares only these integer seconds, never the fraction.
    """
    head = F.split(_col(ts), r"\.", 2).getItem(0)
    return F.coalesce(head.try_cast("bigint"), F.lit(0).cast("bigint"))


def message_instant(ts: Column | str) -> Column:
    """Message timestamp text as a TIMESTAMP with microseconds kept (decimal, never double)."""
    return F.timestamp_seconds(_col(ts).try_cast("decimal(20,6)"))


def canonical_ts(value: Column | str) -> Column:
    """A timestamp key that arrived as JSON text or as a JSON number, as canonical text.

    ``value`` is a VARIANT. Text passes through; a number is rendered from its decimal
    form, so ``1786501755.941399`` keeps every digit (a double would not).
    """
    v = _col(value)
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"),
              F.try_variant_get(v, "$", "string"))
        .when(kind.isin("DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "decimal(20,6)").cast("string"))
    )
