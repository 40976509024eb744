"""Statistics in EXPLAIN COST texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units and operator weights.
UNITS = {"B": 0, "KiB": 1, "MiB": 2, "GiB": 3, "TiB": 4, "PiB": 5, "EiB": 6}
ROW_UNITS = {"": 1, "K": 10**3, "M": 10**6, "B": 10**9}
WEIGHTS = {"CartesianProduct": ("join", 50), "SortMergeJoin": ("join", 15), "ShuffledHashJoin": ("join", 10), "Exchange": ("shuffle", 8), "BroadcastHashJoin": ("join", 5), "BroadcastNestedLoopJoin": ("join", 50), "HashAggregate": ("aggregate", 5), "Aggregate": ("aggregate", 5), "Sort": ("sort", 3), "FileScan": ("scan", 1), "Scan": ("scan", 1), "Relation": ("scan", 1)}
_STATS = r"Statistics\(sizeInBytes=([0-9.]+(?:E[+-]?[0-9]+)?)\s*([KMGTPE]?i?B)(?:,\s*rowCount=([0-9.]+(?:E[+-]?[0-9]+)?)\s*([KMB]?))?"
_JOIN = r"\b(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|CartesianProduct)\b"
_OPERATOR = r"(?m)^[\s:]*(?:\+-\s*)?(?:\*\(\d+\)\s*)?([A-Za-z]+)"


def _all(c: Column, regex: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(regex), F.lit(group))


def explain_stats(plans: DataFrame) -> DataFrame:
    """plan_id and, of its optimised section, total_size_bytes, estimated_rows, stats_complete, join_types,
    shuffle_count, plan_depth, plan_score; a text without that section has null throughout."""
    section = F.regexp_extract("text", r"(?s)== Optimized Logical Plan ==\s*(.*?)(?=\n==|\z)", 1)
    known = F.contains("text", F.lit("== Optimized Logical Plan =="))
    s = plans.select("plan_id", F.when(known, section).alias("s"))
    power = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(float(1024**v)))])
    unit = F.create_map(*[x for k, v in ROW_UNITS.items() for x in (F.lit(k), F.lit(float(v)))])
    sizes = F.zip_with(_all(F.col("s"), _STATS, 1), _all(F.col("s"), _STATS, 2), lambda v, u: F.floor(v.cast("double") * power[u]).cast("long"))
    counts = F.zip_with(_all(F.col("s"), _STATS, 3), _all(F.col("s"), _STATS, 4), lambda v, u: F.when(v != "", F.floor(v.cast("double") * unit[u]).cast("long")))
    score = F.create_map(*[x for k, (_, w) in WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    ops = _all(F.col("s"), _OPERATOR, 1)
    out = s.withColumns({"_sizes": sizes, "_rows": counts})
    shuffles = F.size(_all(F.col("s"), r"(?m)^[\s:]*(?:[:+]- )?(?:Exchange |Sort \[)", 0))
    return out.select(
        "plan_id", F.when(F.col("s").isNotNull(), F.coalesce(F.array_max("_sizes"), F.lit(0))).alias("total_size_bytes"), F.get(F.filter("_rows", lambda x: x.isNotNull()), F.lit(0)).alias("estimated_rows"),
        F.when(F.col("s").isNotNull(), (F.size("_rows") > 0) & F.forall("_rows", lambda x: x.isNotNull())).alias("stats_complete"), F.array_join(F.array_distinct(_all(F.col("s"), _JOIN, 1)), ",").alias("join_types"),
        F.when(F.col("s").isNotNull(), shuffles).alias("shuffle_count"), F.when(F.col("s").isNotNull(), F.size(_all(F.col("s"), r"\+- ", 0))).alias("plan_depth"), F.aggregate(F.transform(ops, lambda o: F.coalesce(score[o], F.lit(0))), F.lit(0), lambda a, x: a + x).alias("plan_score"))


def own_stats(df: DataFrame) -> tuple[int, int | None]:
    """sizeInBytes and rowCount of a DataFrame's optimised plan, from Catalyst itself."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())), int(str(stats.rowCount().get())) if stats.rowCount().isDefined() else None
