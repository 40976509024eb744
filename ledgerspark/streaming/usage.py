"""Costs by tag and window over a stream of usage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.costs import UNTAGGED, identifier, priced


def streaming_tag_costs(usage: DataFrame, list_prices: DataFrame, tag_key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, tag_value, total_cost_usd of a stream of usage (usage_start_time a timestamp): rows later than the
    watermark are left out, and a window's row is final once the watermark has passed it."""
    tag = F.coalesce(F.col("custom_tags")[identifier(tag_key, "tag_key")], F.lit(UNTAGGED))
    costs = priced(usage.withWatermark("usage_start_time", late), list_prices)
    return costs.groupBy(F.window("usage_start_time", window).alias("w"), tag.alias("tag_value")).agg(F.sum("cost").cast("double").alias("total_cost_usd")).select(F.col("w.start").alias("window_start"), "tag_value", "total_cost_usd")
