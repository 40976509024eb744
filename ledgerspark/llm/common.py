"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import ensure_folder

#: The characters that separate words: space, and tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files go when the execution that wrote them ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ADAPTIVE = "spark.sql.adaptive.enabled"


def durable(df: DataFrame, dealt: bool = False) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint, in the folder that the cluster names in
    spark.checkpoint.dir (see ensure_folder).  What the checkpoint shuffled is freed with it.  dealt: later plans know how df's last repartition dealt its rows,
    and needn't deal them anew."""
    spark = df.sparkSession
    ensure_folder(spark)
    with _settings(spark, {FREE: "true"} | ({ADAPTIVE: "false"} if dealt else {})):
        return df.select("*").checkpoint()


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def fresh(df: DataFrame) -> DataFrame:
    """durable(df) without what a checkpoint still knows of its plan (constraints, partitionings, statistics).  These
    double in every round of a loop of joins, and with them the time to plan it."""
    kept = durable(df)
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), df.sparkSession)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From here on, the session's Arrow batches hold at most BATCH bytes or one row, as both the executor and its Python
    worker keep a batch whole.  A smaller setting stays.  Plans read it when they run, so it isn't set back."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def release() -> None:
    """Gives back what the Arrow pool of a Python worker holds unused.  Workers outlive their tasks, and so does the pool."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The maximal runs of characters other than SPACE_CLASS, in order; of null, none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns labels from: crc32 of the id's digits divisible by 5 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
