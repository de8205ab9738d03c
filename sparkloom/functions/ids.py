"""Identifiers in their canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(col: Column | str) -> Column:
    """Lower-case hexadecimal digits only; blanks around and a leading ``urn:uuid:`` are dropped."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.lower(c), r"^\s*urn:uuid:", "")
    return F.nullif(F.regexp_replace(bare, "[^0-9a-f]+", ""), F.lit(""))
