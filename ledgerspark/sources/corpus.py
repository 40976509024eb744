"""Source files, notebooks and notebook archives as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cells import file_format
from ..plans.rules import glob_regex

_NOTEBOOK = "cells array<struct<cell_type: string, source: string>>, metadata struct<kernelspec: struct<language: string, name: string>>"


def source_files(spark: SparkSession, root: str, recursive: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, language, content of the .py, .sql and .dbsql files below root, but for paths like one of exclude (glob)."""
    read = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{py,sql,dbsql}")
    files = read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    for glob in exclude:
        files = files.where(~F.col("path").rlike(glob_regex(glob)))
    return files.select("path", file_format(F.col("path")).alias("language"), "content")


def _language(text, default):
    """By the cell's leading magic, else the notebook's language."""
    t = F.trim(text)
    return F.when(t.startswith("%sql"), "sql").when(t.startswith("%scala"), "scala").when(t.startswith("%python"), "python").otherwise(F.coalesce(default, F.lit("python")))


def notebook_cells(spark: SparkSession, root: str) -> DataFrame:
    """path, cell_index, language, source of the code cells of .ipynb files; cells of text count in the index."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ipynb").text(root, wholetext=True)
    # a cell's source is a list of lines or one string; either becomes the string
    listed = raw.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "cells array<struct<cell_type: string, source: array<string>>>, metadata struct<kernelspec: struct<language: string>>").alias("l"), F.from_json("value", _NOTEBOOK).alias("s"))
    default = F.coalesce("l.metadata.kernelspec.language", "s.metadata.kernelspec.language")
    cells = listed.select("path", default.alias("default"), F.posexplode("s.cells").alias("cell_index", "cell"), F.col("l.cells").alias("lists"))
    joined = F.array_join(F.get(F.col("lists"), F.col("cell_index"))["source"], "")
    text = F.coalesce(joined, F.col("cell.source"))
    return cells.where("cell.cell_type = 'code'").select("path", "cell_index", _language(text, F.col("default")).alias("language"), text.alias("source"))


def archive_cells(spark: SparkSession, root: str) -> DataFrame:
    """path, member, cell_index, language, source of the commands in .dbc archives; members that aren't JSON are left
    out."""

    def run(batches: Iterator) -> Iterator:
        import io
        import json
        import zipfile

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        try:
                            book = json.loads(z.read(name))
                        except (ValueError, UnicodeDecodeError):
                            continue
                        if isinstance(book, dict):
                            rows += [(path, name, i, c.get("language") or book.get("language") or "python", c.get("commandText") or c.get("command") or "") for i, c in enumerate(book.get("commands", []))]
            yield pd.DataFrame(rows, columns=["path", "member", "cell_index", "language", "source"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dbc").load(root).select("path", "content")
    return files.mapInPandas(run, "path string, member string, cell_index int, language string, source string")


def cluster_configs(payloads: DataFrame) -> DataFrame:
    """Clusters described by Jobs-API JSON (id, payload): node type, workers, autoscale, photon, spot."""
    j = F.from_json("payload", "node_type_id string, driver_node_type_id string, num_workers int, spark_version string, runtime_engine string, autoscale struct<min_workers: int, max_workers: int>, azure_attributes struct<availability: string>, aws_attributes struct<availability: string>")
    c = payloads.select("id", j.alias("c"))
    spot = F.upper(F.coalesce("c.azure_attributes.availability", "c.aws_attributes.availability", F.lit("ON_DEMAND")))
    photon = F.coalesce(F.upper("c.runtime_engine") == "PHOTON", F.lit(False)) | F.coalesce(F.contains(F.lower("c.spark_version"), F.lit("photon")), F.lit(False))
    return c.select("id", F.col("c.node_type_id").alias("instance_type"), F.coalesce("c.driver_node_type_id", "c.node_type_id").alias("driver_type"), F.coalesce("c.num_workers", "c.autoscale.min_workers", F.lit(1)).alias("num_workers"), F.col("c.autoscale.max_workers").alias("max_workers"), photon.alias("photon"), F.contains(spot, F.lit("SPOT")).alias("spot"))
