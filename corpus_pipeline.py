"""From raw documents to packed training sequences, in five stages.

Each stage is ``f(spark, docs, sf_dir)``; its result is written as Parquet and read again as the ``docs`` of the next. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import minhash, packing, secret_scan, suffix_dedup, toxicity
from quillgraph.llm.common import staged, table

#: Passages of over 50 words have at least this many bytes (50 words of a byte, and the spaces between).
REPEAT_BYTES = 100


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't reject; it learns from the labelled ones among ``docs``."""
    return toxicity.harmless(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the smallest id) of each group of near copies: five words, similarity 0.8 or more."""
    found = minhash.near_duplicates(docs, minhash.Setting(shingle=5, percent=80))
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept and doc_id is not null").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document of a smaller id as well are cut out of the text."""
    return suffix_dedup.deduplicated(docs, REPEAT_BYTES).withColumn("n_chars", F.char_length("text").cast("long"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out; every document stays."""
    return secret_scan.redacted(docs, secret_scan.train(docs)).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in the sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", without_toxic), ("minhash", without_near_copies), ("suffixes", without_repeats), ("secrets", without_secrets), ("packing", packed)]

#: The models and the packing can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
