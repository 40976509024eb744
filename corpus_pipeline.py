"""The training-data pipeline: five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``.  A row is a document; rows with a null id or text pass through the stages by the rules that each
operator's docstring states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import bpe, decontaminate, near_dedup, pii, quality_model
from ledgerspark.llm.common import durable, table

#: Documents scored lower go.
QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the classifier on the labelled documents among docs and keeps what it scores at QUALITY or more."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_model.score_column(model, F.col("text")) >= QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the least id stays; rows with one id are one
    document."""
    dropped = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a segment of a benchmark item go."""
    return docs.where(~decontaminate.is_leaked(table(spark, sf_dir, "benchmark"), F.col("text")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes <kind>; n_chars follows the text.  A null text stays null."""
    found = pii.find_spans(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].alias("text")), keep=("_row", "text"))
    masked = found.select("_row", pii.masked(F.col("text"), F.col("spans")).alias("_masked"))
    new = {"text": F.col("_masked"), "n_chars": F.length("_masked").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return masked.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_leaks), ("pii", mask_personal_data), ("bpe", encode)]

#: SQL can't express the learned stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
