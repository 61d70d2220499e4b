"""The corpus pipeline: documents through five operators of the training-data subpackage.

Every stage reads what the one before it wrote and returns the columns of documents, the last one the
digests of the encoding. Rows with a null id are documents like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import byte_pairs, decontamination, line_chunks, near_copies, simhash, toxicity
from tessella.llm.common import free_name, held_out, table
from tessella.storage import new_folder


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field calls toxic go."""
    field = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    into = tuple(free_name(docs, name) for name in ("score", "predicted", "spans"))
    return toxicity.score(docs, field, "text", docs.columns, into).filter(F.col(into[1]) == 0).select(docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, to the line; every document stays, and its length is counted anew."""
    gone = free_name(docs, "n_removed")
    cut = line_chunks.dedup_passages(docs, n_removed=gone)
    return cut.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, and of its repeated rows one."""
    return simhash.first_of_each(docs, group=near_copies.near_copies)


def benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    into = (free_name(docs, "item_ids"), free_name(docs, "similarity"))
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), into=into)
    return found.filter(F.size(into[0]) == 0).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, decoded again, as digests."""
    return byte_pairs.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("simhash", near_duplicates),
    ("decontamination", benchmark_documents),
    ("byte_pairs", encoded),
]

# The stages learn, hash and encode as SQL cannot; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
