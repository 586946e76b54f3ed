"""Typed field access on JSON documents kept as VARIANT.

``get_json_object`` cannot tell ``1`` from ``"1"``; these helpers check the JSON
type first, like a strict ``typeof value === "string"`` test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_type(v: Column | str, path: str) -> Column:
    """Upper-case variant type name at ``path`` ('STRING', 'BIGINT', 'OBJECT<...>', ...), null when absent."""
    return F.schema_of_variant(F.try_variant_get(_col(v), path, "variant"))


def str_field(v: Column | str, path: str) -> Column:
    """The value at ``path`` only when it is a JSON string, else null."""
    return F.when(json_type(v, path) == "STRING", F.try_variant_get(_col(v), path, "string"))


def count_field(v: Column | str, path: str, default: int | None = 0) -> Column:
    """A non-negative JSON integer at ``path``, else ``default``."""
    kind = json_type(v, path)
    value = F.try_variant_get(_col(v), path, "bigint")
    is_integer = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (
        kind.startswith("DECIMAL") & (F.try_variant_get(_col(v), path, "decimal(38,6)") == value)
    )
    good = F.when(is_integer & (value >= 0), value)
    return good if default is None else F.coalesce(good, F.lit(default).cast("bigint"))


def is_object(v: Column | str, path: str = "$") -> Column:
    """True when the value at ``path`` is a JSON object."""
    return F.coalesce(json_type(v, path).startswith("OBJECT"), F.lit(False))


def http_ok(status: Column | str) -> Column:
    """A response status of 200 to 299; a response without a status counts by its body alone."""
    return F.coalesce(_col(status).between(200, 299), F.lit(True))
