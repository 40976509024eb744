"""Scaling, session, price, currency and budget arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import rounded

CLIFF_BYTES, CLIFF_FACTOR, DRIVER_BYTES = 1e9, 3.0, 1e9
# Dollars a DBU by SKU, and factors.
DBU_RATES = (("ALL_PURPOSE", "0.55"), ("JOBS_COMPUTE", "0.30"), ("DLT_CORE", "0.30"), ("DLT_PRO", "0.38"), ("DLT_ADVANCED", "0.54"), ("SQL_CLASSIC", "0.22"), ("SQL_PRO", "0.55"), ("SQL_SERVERLESS", "0.70"), ("SERVERLESS_JOBS", "0.45"), ("SERVERLESS_NOTEBOOKS", "0.95"))
PHOTON_FACTOR, EUR_FACTOR = "2.5", "0.92"


def linear(b: Column, c: Column) -> Column:
    return b * c


def linear_with_cliff(b: Column, factor: float = CLIFF_FACTOR, at: float = CLIFF_BYTES) -> Column:
    """The whole input costs the factor beyond the cliff."""
    return F.when(b < at, b * 1.0).otherwise(b * factor)


def quadratic(left: Column, right: Column) -> Column:
    return left * right * 1e-12


def step_failure(b: Column, c: Column, at: float = DRIVER_BYTES) -> Column:
    """b * c, or null (a failure) where b is more than the driver holds."""
    return F.when(b <= at, b * c)


def maintenance(b: Column, files: Column) -> Column:
    return (b + files * 1e6) * 1e-8


def scaled(kind: Column, b: Column, c: Column) -> Column:
    return F.when(kind == "linear", linear(b, c)).when(kind == "linear_with_cliff", linear_with_cliff(b) * c).when(kind == "quadratic", quadratic(b, b)).when(kind == "step_failure", F.coalesce(step_failure(b, c), F.lit(0.0))).when(kind == "maintenance", maintenance(b, F.lit(0.0)))


def session_cost(sessions: DataFrame) -> DataFrame:
    """session_id, exec_cost_usd, idle_cost_usd, total_cost_usd, utilization_pct of (session_id, exec_seconds,
    total_seconds, usd_per_hour); a session without time costs nothing."""
    run, total = F.col("exec_seconds").cast("double"), F.col("total_seconds").cast("double")
    idle = F.greatest(total - run, F.lit(0.0))
    some = total > 0
    cost = lambda s: rounded(F.when(some, s / 3600.0 * F.col("usd_per_hour")).otherwise(0.0), 4)
    return sessions.select("session_id", cost(run).alias("exec_cost_usd"), cost(idle).alias("idle_cost_usd"), cost(run + idle).alias("total_cost_usd"), rounded(F.when(some, run / total * 100.0).otherwise(0.0), 1).alias("utilization_pct"))


def rates_table(spark) -> DataFrame:
    return spark.createDataFrame(list(DBU_RATES), "sku string, rate string").select("sku", F.col("rate").cast("decimal(10,2)").alias("rate"))


def dbu_cost(work: DataFrame, rates: DataFrame) -> DataFrame:
    """work (id, sku, dbu, photon) with rate, cost_usd and cost_eur; SKUs are compared in upper case, an unknown one has
    no cost."""
    dbu = F.col("dbu").cast("decimal(18,4)") * F.when(F.col("photon"), F.lit(PHOTON_FACTOR)).otherwise("1.0").cast("decimal(3,1)")
    priced = work.join(rates, F.upper(work["sku"]) == rates["sku"], "left").select("id", work["sku"], rates["rate"].cast("double").alias("rate"), (dbu * rates["rate"]).alias("usd"))
    return priced.select("id", "sku", "rate", rounded(F.col("usd"), 4).alias("cost_usd"), rounded(F.col("usd") * F.lit(EUR_FACTOR).cast("decimal(4,2)"), 4).alias("cost_eur"))


def rate_day(day: Column) -> Column:
    """The day whose exchange rate counts: of a weekend, the Friday before."""
    back = F.greatest(F.weekday(day) - 4, F.lit(0))
    return F.date_sub(day, back)


def fx_convert(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """amounts (id, day, currency_from, currency_to, amount) with converted; equal currencies convert at 1, an unknown
    rate (rates: rate_day, currency_from, currency_to, rate) gives null."""
    asked = amounts.withColumn("rate_day", rate_day(F.col("day")))
    same = F.col("currency_from") == F.col("currency_to")
    return asked.join(rates, ["rate_day", "currency_from", "currency_to"], "left").select("id", F.col("rate_day").cast("string").alias("rate_day"), rounded(F.when(same, F.col("amount")).otherwise(F.col("amount") * F.col("rate")), 4).alias("converted"))


def budget_gate(estimates: DataFrame) -> DataFrame:
    """estimates (id, cost, budget, rate) with status: no_budget, over (cost beyond the budget times rate) or ok."""
    limit = F.col("budget") * F.coalesce("rate", F.lit(1.0))
    return estimates.select("id", F.when(F.col("budget").isNull(), "no_budget").when(F.col("cost") > limit, "over").otherwise("ok").alias("status"))


def compared(scenarios: DataFrame, baseline: str) -> DataFrame:
    """grp, name, cost, confidence, saving, saving_pct, verified: every scenario of a group (grp, name, cost,
    confidence) beside the baseline scenario of the group; null where either cost is unknown or the baseline's is 0.
    verified: the cost was measured (confidence 1) rather than estimated."""
    base = scenarios.where(F.col("name") == baseline).groupBy("grp").agg(F.min("cost").alias("_base"))
    saving = F.col("_base") - F.col("cost")
    return scenarios.join(base, "grp", "left").select("grp", "name", "cost", "confidence", saving.alias("saving"), F.try_divide(saving, F.col("_base")).alias("saving_pct"), (F.col("confidence") >= 1).alias("verified"))


def best_scenario(scenarios: DataFrame, ties: tuple[str, ...] = (), unknown: Column | None = None) -> DataFrame:
    """Of each group's scenarios (grp, name, cost, confidence) the cheapest, then the most trusted, then the least by the
    columns ties, then by name; nulls come last, and a scenario without a name only where a group has no other.  An
    unknown cost counts as infinite: one that is null or 0, or as the caller says."""
    lost = F.coalesce("cost", F.lit(0.0)) == 0 if unknown is None else unknown
    order = [F.when(lost, F.lit(float("inf"))).otherwise(F.col("cost")), -F.col("confidence"), *map(F.col, ties), F.col("name")]
    key = F.struct(F.col("name").isNull(), *[x for o in order for x in (o.isNull(), o)])
    return scenarios.groupBy("grp").agg(F.min_by("name", key).alias("best"))
