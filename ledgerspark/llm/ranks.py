"""Gapless positions within keys, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task numbers, about.
ROWS_A_TASK = 20_000


def salts(rows: int) -> int:
    return max(16, -(-rows // ROWS_A_TASK))


def ranked(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str, extra: DataFrame | None = None) -> DataFrame:
    """df with a column name: 0, 1, ... within keys (an empty list: over all).  A key's rows are dealt over salts(rows)
    buckets by a hash of order, each bucket is numbered on its own, and buckets get their offsets from their counts.
    extra, a row per key, is joined to the buckets' offsets rather than to the rows, so that no hot key meets it.
    order must tell rows apart unless they are equal."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order, F.lit(name)), F.lit(salts(rows))).cast("int"))
    by = [*keys, "_salt"]
    counts = salted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before: Column = F.sum("_n").over((Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_salt")) - F.col("_n")
    offsets = counts.select(*by, before.alias("_before"))
    if extra is not None:
        offsets = offsets.join(extra, keys)
    numbered = salted.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return numbered.join(offsets, by).withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_salt", "_at", "_before")
