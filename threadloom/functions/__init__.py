"""Column-level functions (N-series): all built from pyspark.sql.functions, JVM-side."""

from threadloom.functions.cost import digest_message, message_cost
from threadloom.functions.json_fields import count_field, is_object, str_field
from threadloom.functions.names import display_name
from threadloom.functions.timestamps import canonical_ts, message_instant, message_secs

__all__ = [
    "canonical_ts",
    "count_field",
    "digest_message",
    "display_name",
    "is_object",
    "message_cost",
    "message_instant",
    "message_secs",
    "str_field",
]
