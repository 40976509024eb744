"""Live files of a transaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ACTION = "add struct<path: string, size: bigint, stats: string>, remove struct<path: string>"


def read_log(spark: SparkSession, table_path: str) -> DataFrame:
    """seq, path, action, size, num_records of all *.json files of the log, in the order of names and lines; lines that
    aren't JSON are left out, and where a line has both actions the add counts."""
    lines = spark.read.option("pathGlobFilter", "*.json").text(f"{table_path}/_delta_log").select(F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("seq"), F.from_json("value", _ACTION).alias("a"))
    known = lines.where("a.add.path IS NOT NULL OR a.remove.path IS NOT NULL")
    return known.select("seq", F.coalesce("a.add.path", "a.remove.path").alias("path"), F.when(F.col("a.add.path").isNotNull(), "add").otherwise("remove").alias("action"), F.coalesce("a.add.size", F.lit(0)).alias("size"), F.get_json_object("a.add.stats", "$.numRecords").cast("long").alias("num_records"))


def live_files(actions: DataFrame) -> DataFrame:
    """path, size, num_records of the files whose last action adds them."""
    last = actions.groupBy("path").agg(F.max_by(F.struct("action", "size", "num_records"), "seq").alias("x"))
    return last.where("x.action = 'add'").select("path", "x.size", "x.num_records")


def table_stats(files: DataFrame) -> DataFrame:
    """num_files, size_bytes, num_records (null unless every live file states it, or if there is none)."""
    complete = (F.count("num_records") == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0)
    return files.agg(F.count(F.lit(1)).alias("num_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"), F.when(complete, F.sum("num_records")).alias("num_records"))


def detail(spark: SparkSession, name: str) -> DataFrame:
    """location, size_bytes, num_files, num_records (unknown), partition_columns of a catalog table, by its files."""
    df = spark.table(name)
    of = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    partitions = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    files = spark.createDataFrame([(f,) for f in df.inputFiles()], "path string")
    return files.agg(F.count(F.lit(1)).alias("num_files")).select(F.lit(of.get("Location", "")).alias("location"), F.lit(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))).alias("size_bytes"), "num_files", F.lit(None).cast("long").alias("num_records"), F.array(*map(F.lit, partitions)).cast("array<string>").alias("partition_columns"))
