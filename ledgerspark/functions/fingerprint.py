"""Normal form and fingerprint of SQL texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is replaced, in this order (white space and digits as Python's re takes them).
STEPS = (
    (r"--[^\n]*", ""),
    (r"(?s)/\*.*?\*/", ""),
    (r"(?U)\s+", " "),
    None,  # trim and upper case
    (r"'[^']*'", "?"),
    (r"(?U)(?<![a-zA-Z_])\d+(\.\d+)?(?![a-zA-Z_])", "?"),
    (r"IN\s*\(\s*\?(?:\s*,\s*\?)*\s*\)", "IN (?)"),
)


def normalized(sql: Column) -> Column:
    for step in STEPS:
        sql = F.upper(F.trim(sql)) if step is None else F.regexp_replace(sql, *step)
    return sql


def fingerprint(sql: Column) -> Column:
    """SHA-256 of the normal form; of a null or empty text, 'unknown'."""
    return F.when(F.coalesce(sql, F.lit("")) == "", "unknown").otherwise(F.sha2(normalized(sql), 256))
