"""Arithmetic with one defined result on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PRICE = "0.55"


def rounded(x: Column, digits: int) -> Column:
    """x half-up at that many decimals, by way of a decimal, as a double."""
    return F.round(x.cast("decimal(28,10)"), digits).cast("double")


def mean(x: Column) -> Column:
    """The exact sum over the count of what is not null."""
    return F.sum(x).cast("double") / F.count(x)


def median(x: Column) -> Column:
    """The lower of the middle values; exact below a million values in a group, and mergeable."""
    return F.percentile_approx(x, 0.5, 1_000_000)


def ntz(moment: str, days: int = 0) -> Column:
    return F.lit(moment).cast("timestamp_ntz") - F.expr(f"interval {days} days")
