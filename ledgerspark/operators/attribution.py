"""Costs by query: usage meets the statements of its warehouse that overlap it in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..functions.numbers import ntz, rounded
from .costs import priced


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs with equal keys whose closed intervals meet; a missing end makes a point, a missing start no match.

    Intervals are dealt to the days that they touch and meet by equality of keys and day; a pair that shares several
    days counts on the first of them, so no pair is repeated and none needs removing.  Names of columns must differ."""

    def dealt(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        start, end = F.col(span[0]), F.coalesce(F.col(span[1]), F.col(span[0]))
        days = F.when(end >= start, F.sequence(start.cast("date"), end.cast("date"))).otherwise(F.array(start.cast("date")))
        return df.where(start.isNotNull()).withColumns({f"_{name}_first": start.cast("date"), "_day": F.explode(days)})

    a, b = dealt(left, left_span, "a"), dealt(right, right_span, "b")
    end = lambda span: F.coalesce(F.col(span[1]), F.col(span[0]))
    meet = (F.col(left_span[0]) <= end(right_span)) & (F.col(right_span[0]) <= end(left_span))
    return a.join(b, [*keys, "_day"]).where(meet & (F.col("_day") == F.greatest("_a_first", "_b_first"))).drop("_day", "_a_first", "_b_first")


def _usage_slices(usage: DataFrame, list_prices: DataFrame) -> DataFrame:
    """Usage summed over equal warehouses and intervals, before anything is joined."""
    meta = F.col("usage_metadata.warehouse_id")
    known = priced(usage.where(meta.isNotNull()), list_prices)
    return known.groupBy(meta.alias("warehouse_id"), F.col("usage_start_time").alias("u_start"), F.col("usage_end_time").alias("u_end")).agg(F.sum("usage_quantity").alias("dbu"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n_usage"))


def query_costs(usage: DataFrame, history: DataFrame, list_prices: DataFrame) -> DataFrame:
    """query_fingerprint, total_dbu, total_cost_usd, execution_count (pairs), avg_duration_ms (over durations that are
    known and not 0).  A usage row is charged in full to every statement that overlaps it."""
    slices = _usage_slices(usage, list_prices)
    ran = F.nullif("execution_duration_ms", F.lit(0))
    statements = history.groupBy("warehouse_id", F.col("start_time").alias("q_start"), F.col("end_time").alias("q_end"), fingerprint(F.col("statement_text")).alias("query_fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.sum(ran).alias("ms"), F.count(ran).alias("n_ms"))
    pairs = overlap_join(slices, statements, ["warehouse_id"], ("u_start", "u_end"), ("q_start", "q_end"))
    total = pairs.groupBy("query_fingerprint").agg(
        F.sum((F.col("dbu") * F.col("n")).cast("decimal(38,4)")).cast("double").alias("total_dbu"), F.sum((F.col("cost") * F.col("n")).cast("decimal(38,6)")).cast("double").alias("total_cost_usd"),
        F.sum(F.col("n_usage") * F.col("n")).alias("execution_count"), F.sum(F.col("ms") * F.col("n_usage")).alias("_ms"), F.sum(F.col("n_ms") * F.col("n_usage")).alias("_n"))
    average = F.coalesce(F.try_divide(F.col("_ms").cast("double"), F.col("_n")), F.lit(0.0))
    return total.select("query_fingerprint", "total_dbu", "total_cost_usd", "execution_count", rounded(average, 4).alias("avg_duration_ms"))


def query_samples(usage: DataFrame, history: DataFrame, limit: int = 10) -> DataFrame:
    """query_fingerprint, statement_id, start_time, execution_duration_ms: the newest statements that usage overlaps."""
    spans = usage.select(F.col("usage_metadata.warehouse_id").alias("warehouse_id"), F.col("usage_start_time").alias("u_start"), F.col("usage_end_time").alias("u_end")).where("warehouse_id IS NOT NULL").distinct()
    named = history.withColumn("query_fingerprint", fingerprint(F.col("statement_text"))).withColumnsRenamed({"start_time": "q_start", "end_time": "q_end"})
    met = overlap_join(named, spans, ["warehouse_id"], ("q_start", "q_end"), ("u_start", "u_end")).select("query_fingerprint", "statement_id", F.col("q_start").alias("start_time"), "execution_duration_ms").distinct()
    newest = Window.partitionBy("query_fingerprint").orderBy(F.desc("start_time"), "statement_id")
    return met.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= limit).drop("_r")


def within(usage: DataFrame, history: DataFrame, warehouse_id: str | None = None, as_of: str | None = None, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """usage and history of one warehouse and of the days before as_of, for the reports below."""
    if warehouse_id is not None:
        usage, history = usage.where(F.col("usage_metadata.warehouse_id") == warehouse_id), history.where(F.col("warehouse_id") == warehouse_id)
    if as_of is not None:
        usage, history = usage.where(F.col("usage_start_time") >= ntz(as_of, days)), history.where(F.col("start_time") >= ntz(as_of, days))
    return usage, history


def similar_queries(history: DataFrame, wanted: Column, limit: int = 10, warehouse_id: str | None = None) -> DataFrame:
    """Finished statements (of one warehouse, if named) with that fingerprint: the newest limit of those among the
    newest limit * 100."""
    if warehouse_id is not None:
        history = history.where(F.col("warehouse_id") == warehouse_id)
    newest = history.where(F.col("status") == "FINISHED").orderBy(F.desc("start_time"), "statement_id").limit(limit * 100)
    return newest.withColumn("query_fingerprint", fingerprint(F.col("statement_text"))).where(F.col("query_fingerprint") == wanted).orderBy(F.desc("start_time"), "statement_id").limit(limit)


def historical_cost(usage: DataFrame, history: DataFrame, list_prices: DataFrame, wanted: Column, limit: int = 100, warehouse_id: str | None = None, as_of: str | None = None, days: int = 30) -> DataFrame:
    """Cost of the statements like the wanted one: no row where they used nothing.  execution_count is the number of
    statements; the mean is over durations that are known and not 0; samples are the ten newest statements.
    warehouse_id restricts both tables, as_of and days the usage."""
    usage, _ = within(usage, history, warehouse_id, as_of, days)
    like = similar_queries(history, wanted, limit, warehouse_id).withColumnsRenamed({"start_time": "q_start", "end_time": "q_end"})
    used = overlap_join(_usage_slices(usage, list_prices), like.select("warehouse_id", "q_start", "q_end"), ["warehouse_id"], ("u_start", "u_end"), ("q_start", "q_end"))
    cost = used.agg(F.sum("dbu").cast("double").alias("total_dbu"), F.sum("cost").cast("double").alias("total_cost_usd"))
    ran = F.nullif("execution_duration_ms", F.lit(0))
    about = like.agg(F.max("query_fingerprint").alias("query_fingerprint"), F.count(F.lit(1)).alias("execution_count"), F.coalesce(rounded(F.avg(ran), 4), F.lit(0.0)).alias("avg_duration_ms"), F.collect_list(F.struct((-F.unix_micros(F.col("q_start").cast("timestamp"))).alias("o"), "statement_id", F.col("q_start").alias("start_time"), F.col("execution_duration_ms").alias("duration_ms"))).alias("samples"))  # at most limit rows
    ten = F.transform(F.slice(F.array_sort("samples"), 1, 10), lambda x: x.dropFields("o"))
    about = about.withColumn("samples", ten)
    return about.crossJoin(cost).where("total_dbu <> 0").select("query_fingerprint", "execution_count", "avg_duration_ms", "total_dbu", "total_cost_usd", "samples")  # one row each


def run_costs(runs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Job runs with their usage and cost; rows whose numbers don't parse are left out."""
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    return runs.where(F.col("start_time") >= ntz(as_of, days)).select("job_id", "run_id", "start_time", "end_time", number("dbu_total").alias("dbu_total"), number("cost_usd").alias("cost_usd")).where("dbu_total IS NOT NULL AND cost_usd IS NOT NULL").orderBy(F.desc("start_time"), "run_id")
