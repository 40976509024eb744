"""Reports of what workloads cost."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import DEFAULT_PRICE, mean, median, ntz, rounded

UNTAGGED = "__untagged__"
IDLE_ADVICE = "Enable auto-termination (idle > 10 min) or terminate manually."
_IDENTIFIER = re.compile(r"[A-Za-z0-9_-]{1,256}")


def identifier(value: str, name: str = "id") -> str:
    """value, if it is made of letters, digits, _ and - only."""
    if not _IDENTIFIER.fullmatch(value):
        raise ValueError(f"{name} may hold letters, digits, _ and - only, at most 256: {value!r}")
    return value


def open_prices(list_prices: DataFrame) -> DataFrame:
    return list_prices.where(F.col("price_end_time").isNull()).select("sku_name", F.col("pricing.default").alias("price_usd"))


def priced(usage: DataFrame, list_prices: DataFrame) -> DataFrame:
    """usage with cost: quantity times the open list price, or the default price.  The dimension is broadcast if its
    size is under the session's threshold."""
    cost = F.col("usage_quantity") * F.coalesce(F.col("price_usd"), F.lit(DEFAULT_PRICE).cast("decimal(10,2)"))
    return usage.join(open_prices(list_prices), "sku_name", "left").withColumn("cost", cost)


def _since(column: str, as_of: str, days: int) -> Column:
    return F.col(column) >= ntz(as_of, days)


def tag_costs(usage: DataFrame, list_prices: DataFrame, tag_key: str, as_of: str, days: int = 30) -> DataFrame:
    """tag_value, total_cost_usd: dearest first; usage without the tag counts as __untagged__, an empty tag drops out."""
    tag = F.coalesce(F.col("custom_tags")[identifier(tag_key, "tag_key")], F.lit(UNTAGGED))
    recent = priced(usage.where(_since("usage_start_time", as_of, days)), list_prices)
    return recent.groupBy(tag.alias("tag_value")).agg(F.sum("cost").cast("double").alias("total_cost_usd")).where("tag_value <> ''").orderBy(F.desc("total_cost_usd"), "tag_value")


def idle_clusters(node_timeline: DataFrame, usage: DataFrame, list_prices: DataFrame, as_of: str, days: int = 7, threshold: float = 0.10, sku: str = "ALL_PURPOSE") -> DataFrame:
    """cluster_id, avg_cpu_pct, running_hours, total_cost_usd, wasted_cost_usd, recommendation of clusters whose
    workers' mean CPU is under the threshold; most waste first."""
    seconds = F.expr(f"timestampdiff(SECOND, start_time, coalesce(end_time, timestamp_ntz '{as_of}'))")
    nodes = node_timeline.where(_since("start_time", as_of, days) & ~F.col("driver")).groupBy("cluster_id").agg(mean(F.col("avg_cpu")).alias("cpu"), (F.sum(seconds) / 3600.0).alias("hours"))
    bought = usage.where(_since("usage_start_time", as_of, days) & (F.col("sku_name") == sku) & F.col("usage_metadata.cluster_id").isNotNull())
    costs = priced(bought, list_prices).groupBy(F.col("usage_metadata.cluster_id").alias("cluster_id")).agg(F.sum("cost").cast("double").alias("total"))
    idle = nodes.where(F.col("cpu") < threshold * 100).join(costs, "cluster_id")
    out = idle.select("cluster_id", rounded(F.col("cpu"), 2).alias("avg_cpu_pct"), rounded(F.col("hours"), 2).alias("running_hours"), rounded(F.col("total"), 4).alias("total_cost_usd"), rounded(F.col("total") * (1.0 - F.col("cpu") / 100.0), 4).alias("wasted_cost_usd"), F.lit(IDLE_ADVICE).alias("recommendation"))
    return out.orderBy(F.desc("wasted_cost_usd"), "cluster_id")


def cost_drift(usage: DataFrame, list_prices: DataFrame, as_of: str, days: int = 30, threshold: float = 0.25) -> DataFrame:
    """resource_id, median_cost, recent_avg, drift_ratio: jobs and pipelines whose mean daily cost of the last seven
    days is off their median before by the threshold; the daily costs are aggregated once for both periods."""
    meta = F.col("usage_metadata")
    resource = F.when(meta["job_id"].isNotNull(), F.concat(F.lit("job:"), meta["job_id"])).when(meta["dlt_pipeline_id"].isNotNull(), F.concat(F.lit("pipeline:"), meta["dlt_pipeline_id"]))
    known = usage.where(_since("usage_start_time", as_of, days) & (meta["job_id"].isNotNull() | meta["dlt_pipeline_id"].isNotNull()))
    daily = priced(known, list_prices).groupBy(resource.alias("resource_id"), F.col("usage_start_time").cast("date").alias("day")).agg(F.sum("cost").alias("cost"))
    recent = F.col("day").cast("timestamp_ntz") >= ntz(as_of, 7)
    both = daily.groupBy("resource_id").agg(median(F.when(~recent, F.col("cost"))).cast("double").alias("median_cost"), mean(F.when(recent, F.col("cost"))).alias("recent_avg")).where("median_cost > 0 AND recent_avg IS NOT NULL")
    ratio = (F.col("recent_avg") - F.col("median_cost")) / F.col("median_cost")
    return both.where(F.abs(ratio) >= threshold).select("resource_id", rounded(F.col("median_cost"), 4).alias("median_cost"), rounded(F.col("recent_avg"), 4).alias("recent_avg"), rounded(ratio, 4).alias("drift_ratio")).orderBy(F.desc(F.abs("drift_ratio")), "resource_id")


def job_report(runs: DataFrame, usage: DataFrame, list_prices: DataFrame, as_of: str, job_id: str | None = None, limit: int = 30, days: int = 30) -> DataFrame:
    """The newest runs with their cost, its change against the median of the job's runs among them, and an annotation
    beyond 20 percent either way.  The newest runs are chosen before any join: the limit cuts whole groups."""
    chosen = runs.where(_since("start_time", as_of, days))
    if job_id is not None:
        chosen = chosen.where(F.col("job_id") == identifier(job_id, "job_id"))
    keys = ["job_id", "run_id", "start_time", "end_time", "result_state"]
    newest = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.desc("start_time"), "job_id", "run_id", "end_time", "result_state").limit(limit)
    meta = F.col("usage_metadata")
    cost = priced(usage.where(meta["job_id"].isNotNull()).withColumns({"job_id": meta["job_id"], "run_id": meta["job_run_id"]}), list_prices)
    # costs are summed where the newest runs are known, so only theirs are shuffled beyond the join
    total = newest.join(cost, ["job_id", "run_id"], "left").groupBy(*keys).agg((F.sum("cost") * F.max("_rows")).cast("decimal(38,6)").alias("total"))
    medians = total.groupBy("job_id").agg(median(F.col("total")).alias("median"))
    pct = (F.col("total").cast("double") - F.col("median").cast("double")) / F.nullif(F.col("median").cast("double"), F.lit(0.0))
    out = total.join(medians, "job_id").select(*keys, F.coalesce(rounded(F.col("total"), 4), F.lit(0.0)).alias("total_cost_usd"), F.coalesce(rounded(pct, 4), F.lit(0.0)).alias("pct_change_vs_median"))
    p = F.col("pct_change_vs_median")
    whole = F.bround((p * 100).cast("decimal(28,6)"), 0).cast("long").cast("string")
    note = F.when(p > 0.20, F.concat(F.lit("spike (+"), whole, F.lit("%)"))).when(p < -0.20, F.concat(F.lit("drop ("), whole, F.lit("%)"))).otherwise("")
    return out.withColumn("annotation", note).orderBy(F.desc("start_time"), "job_id", "run_id")


def pipeline_report(usage: DataFrame, list_prices: DataFrame, event_log: DataFrame, as_of: str, pipeline_id: str | None = None, limit: int = 30, days: int = 30, sku_prefix: str = "DLT") -> DataFrame:
    """pipeline_id, update_date, total_cost_usd, dominant_table (the one with most output rows that day)."""
    meta = F.col("usage_metadata")
    bought = usage.where(_since("usage_start_time", as_of, days) & F.col("sku_name").startswith(sku_prefix) & meta["dlt_pipeline_id"].isNotNull())
    seen = event_log.where((F.col("event_type") == "flow_progress") & _since("timestamp", as_of, days))
    if pipeline_id is not None:
        bought = bought.where(meta["dlt_pipeline_id"] == identifier(pipeline_id, "pipeline_id"))
        seen = seen.where(F.col("pipeline_id") == pipeline_id)
    daily = priced(bought, list_prices).groupBy(meta["dlt_pipeline_id"].alias("pipeline_id"), F.col("usage_start_time").cast("date").alias("update_date")).agg(F.sum("cost").alias("cost"))
    newest = daily.orderBy(F.desc("update_date"), "pipeline_id").limit(limit)
    tables = seen.groupBy("pipeline_id", F.col("timestamp").cast("date").alias("update_date"), "entity_name").agg(F.sum("num_output_rows").alias("rows")).groupBy("pipeline_id", "update_date").agg(F.max_by("entity_name", F.struct("rows", "entity_name")).alias("dominant_table"))
    return newest.join(tables, ["pipeline_id", "update_date"], "left").select("pipeline_id", "update_date", rounded(F.col("cost"), 4).alias("total_cost_usd"), "dominant_table").orderBy(F.desc("update_date"), "pipeline_id")


def watch_report(tags: DataFrame, idle: DataFrame, drift: DataFrame) -> DataFrame:
    """monitor, key, value of the three monitors and the total of the tag costs."""
    rows = tags.select(F.lit("tag").alias("monitor"), F.col("tag_value").alias("key"), F.col("total_cost_usd").alias("value"))
    rows = rows.unionByName(idle.select(F.lit("idle").alias("monitor"), F.col("cluster_id").alias("key"), F.col("wasted_cost_usd").alias("value")))
    rows = rows.unionByName(drift.select(F.lit("drift").alias("monitor"), F.col("resource_id").alias("key"), F.col("drift_ratio").alias("value")))
    total = tags.agg(F.coalesce(F.sum(F.col("total_cost_usd").cast("decimal(28,6)")), F.lit(0)).cast("double").alias("value")).select(F.lit("total").alias("monitor"), F.lit("usd").alias("key"), "value")
    return rows.unionByName(total)
