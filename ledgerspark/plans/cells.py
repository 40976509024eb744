"""Modes, cells and includes of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import checkpointed

# Fixed values.
PIPELINE_MARKERS = ("import sdp", "from sdp import", "@sdp.table", "@dp.table", "@dp.materialized_view", "create streaming table", "create materialized view", "live.ref")
SQL_STARTS = ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE")


def mode(content: Column) -> Column:
    """sdp, sql or python."""
    low = F.lower(content)
    marked = F.lit(False)
    for m in PIPELINE_MARKERS:
        marked = marked | F.contains(low, F.lit(m))
    return F.when(marked, "sdp").when(F.upper(F.regexp_replace(content, r"^\s+", "")).rlike(f"^(?:{'|'.join(SQL_STARTS)})"), "sql").otherwise("python")


def file_format(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".ipynb"), "notebook").when(low.endswith(".sql") | low.endswith(".dbsql"), "sql").when(low.endswith(".py"), "python")


def split_cells(lines: DataFrame) -> DataFrame:
    """path, cell_index, kind, source, line_offset (lines before the cell's end) of lines (path, line_no, line).

    A line of magic starts a cell and is dropped; cells without a line are too.  Sessions of lines: a running count."""
    t = F.trim("line")
    kind = F.when(t.startswith("# MAGIC %sql") | t.startswith("# MAGIC sql"), "sql").when(t.startswith("# MAGIC"), "python").when(t.startswith("# COMMAND") | t.startswith("# Databricks notebook source:"), "run_ref")
    run = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_kind", kind).withColumns({"_cell": F.count("_kind").over(run), "_of": F.last("_kind", ignorenulls=True).over(run)})
    cells = marked.where("_kind IS NULL").groupBy("path", "_cell").agg(F.coalesce(F.max("_of"), F.lit("python")).alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("source"), F.max("line_no").cast("int").alias("line_offset"))
    return cells.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("_cell")) - 1).alias("cell_index"), "kind", "source", "line_offset")


def includes(lines: DataFrame) -> DataFrame:
    """src, dst of %run lines."""
    dst = F.regexp_extract("line", r"^\s*(?:# MAGIC\s+)?%run\s+[\"']?([^\s\"']+)", 1)
    return lines.select(F.col("path").alias("src"), dst.alias("dst")).where("dst <> ''").distinct()


def missing_targets(runs: DataFrame, sources: DataFrame) -> DataFrame:
    return runs.join(sources.select(F.col("path").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst").distinct()


def cycles(runs: DataFrame) -> DataFrame:
    """src: the sources that include themselves over any way.  Ways double in length each round, until none is new; a
    round is a checkpoint, so plans don't nest.  Diamonds are no cycles."""
    reach = checkpointed(runs.select("src", "dst").distinct())
    known = reach.count()
    while True:
        further = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        reach = checkpointed(reach.unionByName(further).distinct())
        if (now := reach.count()) == known:
            return reach.where("src = dst").select("src")
        known = now
