"""Plain scans of system tables: usage, prices, node types, clusters, timelines, history."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ntz
from .costs import identifier, open_prices

_MOMENT = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?")


def usage_window(usage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Usage of the last days, newest first."""
    meta = F.col("usage_metadata")
    return usage.where(F.col("usage_start_time") >= ntz(as_of, days)).select("record_id", "sku_name", F.col("usage_quantity").cast("double").alias("usage_quantity"), "usage_start_time", "usage_end_time", meta["cluster_id"].alias("cluster_id"), meta["warehouse_id"].alias("warehouse_id"), meta["job_id"].alias("job_id")).orderBy(F.desc("usage_start_time"), "record_id")


def live_prices(list_prices: DataFrame, skus: list[str]) -> DataFrame:
    """sku_name, price_usd: open, known prices of the skus; of several, the highest."""
    return open_prices(list_prices).where(F.col("sku_name").isin(skus) & F.col("price_usd").isNotNull()).groupBy("sku_name").agg(F.max("price_usd").cast("double").alias("price_usd"))


def node_type_rates(node_types: DataFrame) -> DataFrame:
    return node_types.where(F.col("dbu_per_hour").isNotNull()).select("node_type_id", "dbu_per_hour")


def cluster_configs(clusters: DataFrame, node_types: DataFrame, cluster_id: str | None = None) -> DataFrame:
    """Clusters with their node type's rate (unknown: 0) and workers (null or 0: 1); one of them, if an id is given."""
    if cluster_id is not None:
        clusters = clusters.where(F.col("cluster_id") == identifier(cluster_id, "cluster_id")).limit(1)
    return clusters.join(node_type_rates(node_types), "node_type_id", "left").select("cluster_id", "cluster_name", "node_type_id", F.coalesce(F.nullif("num_workers", F.lit(0)), F.lit(1)).cast("int").alias("num_workers"), F.coalesce("dbu_per_hour", F.lit(0.0)).alias("dbu_per_hour"))


def node_timeline(timeline: DataFrame, cluster_id: str, start: str, end: str) -> DataFrame:
    """The cluster's intervals that lie within start and end."""
    for moment in (start, end):
        if not _MOMENT.fullmatch(moment):
            raise ValueError(f"not an ISO moment: {moment!r}")
    inside = (F.col("cluster_id") == identifier(cluster_id, "cluster_id")) & (F.col("start_time") >= ntz(start)) & (F.col("end_time") <= ntz(end))
    return timeline.where(inside).select("cluster_id", "node_id", "start_time", "end_time", "driver").orderBy("start_time", "node_id")


def query_history(history: DataFrame, warehouse_id: str, as_of: str, days: int = 30, limit: int = 10_000) -> DataFrame:
    """The warehouse's newest statements."""
    return history.where((F.col("warehouse_id") == identifier(warehouse_id, "warehouse_id")) & (F.col("start_time") >= ntz(as_of, days))).orderBy(F.desc("start_time"), "statement_id").limit(limit)


def recent_queries(history: DataFrame, limit: int = 100) -> DataFrame:
    return history.orderBy(F.desc("start_time"), "statement_id").limit(limit)
