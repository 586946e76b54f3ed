"""Display references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_name(name: Column | str, ident: Column | str) -> Column:
    """The cached name when present and different from the id, else the id."""
    n = F.col(name) if isinstance(name, str) else name
    i = F.col(ident) if isinstance(ident, str) else ident
    return F.when(n.isNotNull() & (n != F.lit("")) & (n != i), n).otherwise(i)
