"""What ran, from Spark's own event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGE = "`Stage ID` int, `Stage Attempt ID` int, `Number of Tasks` int, Accumulables array<struct<Name: string, Value: string>>"
_LOG = f"Event string, `Stage Info` struct<{_STAGE}>, executionId bigint, description string, time bigint"
# Our columns and the counters that they add up.
COUNTERS = {"input_bytes": ("input.bytesRead",), "output_bytes": ("output.bytesWritten",), "shuffle_read_bytes": ("shuffle.read.remoteBytesRead", "shuffle.read.localBytesRead"), "shuffle_write_bytes": ("shuffle.write.bytesWritten",), "cpu_ns": ("executorCpuTime",)}
SHUFFLING = r"(?i)crossjoin|shuffle|cartesian|repartition"


def event_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LOG).json(path)


def stage_metrics(events: DataFrame) -> DataFrame:
    """stage_id, attempt, tasks, bytes in and out, shuffled bytes, cpu_seconds of completed stages; absent counters are
    0."""
    done = events.where("Event = 'SparkListenerStageCompleted'").select(F.col("Stage Info").alias("i"))
    found = lambda names: F.aggregate(F.filter("i.Accumulables", lambda a: a["Name"].isin(*[f"internal.metrics.{n}" for n in names])), F.lit(0).cast("long"), lambda s, a: s + F.coalesce(a["Value"].cast("long"), F.lit(0)))
    counted = {name: F.coalesce(found(of), F.lit(0)) for name, of in COUNTERS.items()}
    return done.select(F.col("i.Stage ID").alias("stage_id"), F.col("i.Stage Attempt ID").alias("attempt"), F.col("i.Number of Tasks").alias("tasks"), *[c.alias(n) for n, c in counted.items()]).withColumn("cpu_seconds", F.col("cpu_ns") / 1e9).drop("cpu_ns")


def sql_executions(events: DataFrame) -> DataFrame:
    """execution_id, description, seconds (null while running)."""
    start = events.where(F.col("Event").endswith("SparkListenerSQLExecutionStart")).select("executionId", "description", F.col("time").alias("began"))
    end = events.where(F.col("Event").endswith("SparkListenerSQLExecutionEnd")).select("executionId", F.col("time").alias("ended"))
    return start.join(end, "executionId", "left").select(F.col("executionId").alias("execution_id"), "description", ((F.col("ended") - F.col("began")) / 1000).alias("seconds"))


def merged(findings: DataFrame, stages: DataFrame) -> DataFrame:
    """findings (with a column message) and compute_seconds: all stages' CPU time for findings about shuffles, if more
    than 1 GB was shuffled; else null."""
    total = stages.agg(F.sum("cpu_seconds").alias("_cpu"), F.sum(F.col("shuffle_read_bytes") + F.col("shuffle_write_bytes")).alias("_moved"))
    charged = F.when((F.col("_moved") > 1e9) & F.col("message").rlike(SHUFFLING), F.col("_cpu"))
    return findings.crossJoin(F.broadcast(total)).withColumn("compute_seconds", charged).drop("_cpu", "_moved")  # total is one row
