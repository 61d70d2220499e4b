"""Exam, training log and configuration readers, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.logs import log_losses

EXAM_SCHEMA = "id STRING, question STRING, options MAP<STRING,STRING>, correct_answer STRING"
LOG_SCHEMA = "log_history ARRAY<VARIANT>"  # the keys of records vary
CONFIG_SCHEMA = (
    "benchmarks ARRAY<STRUCT<exam_path: STRING, preprompt_file: STRING, max_new_tokens: INT, temperature: DOUBLE>>"
)
SEGMENT_SCHEMA = (
    "id STRING, paragraph_index BIGINT, orthography_policy STRING, normalized_paragraph STRING, "
    "sentences ARRAY<STRING>, foreign_spans ARRAY<STRUCT<lang: STRING, text: STRING>>"
)
ITEM_SCHEMA = (
    "id STRING, task STRING, prompt STRING, target STRING, "
    "meta STRUCT<source: STRUCT<paragraph_index: BIGINT, sentence_index: BIGINT>, transform: STRING>"
)
# Ids of runs and sweeps are text, whatever they look like in a folder's name.
RUN_RESULT_SCHEMA = (
    "model STRING, accuracy DOUBLE, correct BIGINT, total BIGINT, max_new_tokens BIGINT, temperature DOUBLE, preprompt STRING, "
    "model_path STRING, benchmark_timestamp STRING, run STRING, exam_name STRING"
)
SWEEP_RESULT_SCHEMA = "run STRING, exam_name STRING, accuracy DOUBLE, correct BIGINT, total BIGINT, success BOOLEAN, error STRING, sweep STRING"
MANIFEST_SCHEMA = "total_models BIGINT, successful BIGINT, failed BIGINT, timestamp STRING, sweep STRING"

STEM = r"([^/]+?)(?:\.[^./]*)?$"
# What a file is named by: its own name without the extension, or, where Spark named it, its folder.
NAMED_BY = {"stem": STEM, "folder": r"(?:[^/=]+=)?([^/]+)/[^/]+$"}


def _name(named_by: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), NAMED_BY[named_by], 1)


def read_exams(spark: SparkSession, path: str, named_by: str = "stem") -> DataFrame:
    """Questions of JSON array files; the exam is named by the file, options keep their order."""
    rows = spark.read.schema(EXAM_SCHEMA).json(path, multiLine=True)
    return rows.select(_name(named_by).alias("exam_name"), "id", "question", "options", "correct_answer")


def read_exam_configs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True).select(F.explode("benchmarks").alias("b"))
    return rows.select(F.regexp_extract("b.exam_path", STEM, 1).alias("exam_name"), "b.*")


def read_preprompts(spark: SparkSession, path: str, named_by: str = "stem") -> DataFrame:
    """Whole text files as (name, preprompt). Spark's scans leave out files of no bytes."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(_name(named_by).alias("name"), F.col("value").alias("preprompt"))


def read_log_records(spark: SparkSession, path: str) -> DataFrame:
    """Log records with whatever keys they have, in list order: (run, pos, record).

    One log per file, named by its folder. No history, or an empty one, gives no rows; a file that is
    not JSON is an error.
    """
    rows = spark.read.schema(LOG_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.select(run.alias("run"), F.posexplode("log_history").alias("pos", "record"))


def read_training_logs(spark: SparkSession, path: str) -> DataFrame:
    """The steps and losses of ``read_log_records``."""
    return log_losses(read_log_records(spark, path))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Overwrites; missing fields are left out, non-ASCII text is kept as it is."""
    df.write.mode("overwrite").json(path)


def _replace_own(df: DataFrame, path: str, *parts: str) -> None:
    """Replaces only the folders that ``df`` has rows for; what other writes left stays."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).json(path)


def write_results(scored: DataFrame, path: str) -> None:
    """Detail rows below one folder per run and exam. A rerun replaces itself and nothing else."""
    _replace_own(scored, path, "run", "exam_name")


def write_run_results(results: DataFrame, path: str) -> None:
    """One row per run and exam, with metadata (``sweeps.run_results``); a rerun replaces itself."""
    _replace_own(results, path, "run", "exam_name")


def write_sweep(summary: DataFrame, counts: DataFrame, path: str, sweep: str, timestamp: str) -> None:
    """A sweep's rows and, when they are complete, its one-row manifest; another sweep's stay.

    Rows of one sweep go to files of the cluster's choice, so that the list of runs never is one value.
    """
    named = F.lit(sweep).alias("sweep")
    _replace_own(summary.select("*", named), f"{path}/results", "sweep")
    _replace_own(counts.select("*", F.lit(timestamp).alias("timestamp"), named), f"{path}/manifest", "sweep")


def write_lengths(lengths: DataFrame, path: str) -> None:
    lengths.select("index", "num_tokens").write.mode("overwrite").csv(path, header=True)
