"""Sweeps of many runs: their artefacts, hyper-parameters, ranking and summary figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ordering import rank_rows

# Directory and run name formats.
RUN_NAME = r"lr([\de-]+)_bs(\d+)_ep(\d+)"
FINAL = "final_model"
CHECKPOINT = r"checkpoint-(\d+)"
SWEEP_MARK = "sweep"


def best_artifacts(paths: DataFrame, base: str) -> DataFrame:
    """Per sweep directory the final model, else the highest checkpoint; runs with neither go.

    ``paths`` has one row per file. Partial maxima are taken before the shuffle.
    """
    inside = paths.filter(F.startswith("path", F.lit(f"{base}/")))
    parts = F.split(F.substr("path", F.lit(len(base) + 2)), "/")
    listed = inside.select(F.get(parts, 0).alias("run"), F.get(parts, 1).alias("artifact"), F.get(parts, 2).alias("below"))
    found = listed.filter(F.col("below").isNotNull() & (F.col("artifact") != "") & F.col("run").contains(SWEEP_MARK))
    step = F.regexp_extract("artifact", CHECKPOINT, 1).try_cast("long")
    usable = found.withColumn("final", F.col("artifact") == FINAL).withColumn("step", step)
    usable = usable.filter(F.col("final") | (F.col("artifact").startswith("checkpoint-") & F.col("step").isNotNull()))
    return usable.groupBy("run").agg(F.max_by("artifact", F.struct("final", "step", "artifact")).alias("artifact"))


def run_hyperparams(runs: DataFrame) -> DataFrame:
    """Learning rate, batch size and epochs from the run name; other names leave the table."""
    return (
        runs.select(
            "run",
            F.regexp_extract("run", RUN_NAME, 1).try_cast("double").alias("learning_rate"),
            F.regexp_extract("run", RUN_NAME, 2).try_cast("long").alias("batch_size"),
            F.regexp_extract("run", RUN_NAME, 3).try_cast("long").alias("epochs"),
        )
        .filter(F.col("run").rlike(RUN_NAME))
    )


def run_results(accuracy: DataFrame, configs: DataFrame, artifacts: DataFrame, base: str, timestamp: str) -> DataFrame:
    """One row per run and exam: its figures, how it was asked, which artefact answered and when.

    A run whose artefact is not known has no model path.
    """
    asked = configs.select("run", "exam_name", "max_new_tokens", "temperature", F.col("preprompt"))
    path = F.concat(F.lit(f"{base}/"), "run", F.lit("/"), "artifact")
    return (
        accuracy.join(asked, ["run", "exam_name"], "left")
        .join(artifacts.select("run", path.alias("model_path")), "run", "left")
        .select(
            "run", "exam_name", F.col("run").alias("model"), "accuracy", "correct", "total", "max_new_tokens", "temperature", "preprompt", "model_path",
            F.lit(timestamp).alias("benchmark_timestamp"),
        )
    )


def run_errors(configs: DataFrame, answered: DataFrame, sizes: DataFrame, crashes: DataFrame) -> DataFrame:
    """What went wrong, one row per run, exam and reason: (run, exam_name, stage, error).

    ``configs`` has the runs and their exams, ``answered`` the number of answers (``n``) per run and exam, ``sizes``
    the questions (``n``) per exam, ``crashes`` the error texts of runs, for one exam or, where ``exam_name``
    is null, for all that the run was set up for. An exam without a crash that has no answers, or
    too few, is an error of its own; one without questions is not.
    """
    asked = configs.select("run", "exam_name").distinct()
    told = crashes.select("run", F.col("exam_name").alias("_exam"), "stage", "error")
    crashed = asked.join(told, "run").filter(F.col("_exam").isNull() | (F.col("_exam") == F.col("exam_name"))).drop("_exam")
    silent = asked.join(crashed.select("run", "exam_name").distinct(), ["run", "exam_name"], "left_anti")
    counted = silent.join(answered.select("run", "exam_name", F.col("n").alias("_n")), ["run", "exam_name"], "left").join(
        sizes.select("exam_name", F.col("n").alias("_all")), "exam_name"
    )
    n = F.coalesce("_n", F.lit(0))
    text = F.when(n == 0, "no answers").otherwise(F.format_string("%d of %d questions unanswered", F.col("_all") - n, F.col("_all")))
    partial = counted.filter(n < F.col("_all")).select("run", "exam_name", F.lit("answer").alias("stage"), text.alias("error"))
    return crashed.select("run", "exam_name", "stage", "error").unionByName(partial)


def sweep_summary(runs: DataFrame, accuracy: DataFrame, error: str = "no predictions", errors: DataFrame | None = None) -> DataFrame:
    """Every run once per exam it answered; a run without any answers is a failed run.

    With ``errors`` (``run_errors``) a failed run has its own texts, in order; else the text ``error``.
    """
    joined = runs.join(accuracy, "run", "left")
    text = F.lit(error)
    if errors is not None:
        told = errors.groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("_told"))
        joined, text = joined.join(told, "run", "left"), F.coalesce("_told", F.lit(error))
    ok = F.col("total").isNotNull()
    return joined.select(
        "run",
        "exam_name",
        "accuracy",
        "correct",
        "total",
        ok.alias("success"),
        F.when(~ok, text).alias("error"),
    )


def sweep_counts(summary: DataFrame) -> DataFrame:
    """Runs in all, scored and failed."""
    per_run = summary.groupBy("run").agg(F.bool_or("success").alias("ok"))
    return per_run.agg(
        F.count("*").alias("total_models"),
        F.count_if("ok").alias("successful"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def _best_first() -> list[Column]:
    # Failures go last because their accuracy is missing; ties keep run name order.
    return [F.col("accuracy").desc_nulls_last(), F.col("run"), F.col("exam_name").asc_nulls_last()]


def leaderboard(summary: DataFrame) -> DataFrame:
    return rank_rows(summary, _best_first(), "rank")


def leaderboard_top(summary: DataFrame, k: int = 3) -> DataFrame:
    """The best ``k`` successes: a distributed top-k; the rank window sees only these rows."""
    top = summary.filter("success").orderBy(*_best_first()).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*_best_first())).cast("long"))


def sweep_metrics(summary: DataFrame) -> DataFrame:
    return summary.filter("success").agg(
        F.round(F.max("accuracy"), 6).alias("best_accuracy"),
        F.round(F.min("accuracy"), 6).alias("worst_accuracy"),
        F.round(F.avg("accuracy"), 6).alias("mean_accuracy"),
        F.count("*").alias("scored"),
    )


def sweep_by_param(summary: DataFrame) -> DataFrame:
    scored = summary.filter("success").join(run_hyperparams(summary.select("run").distinct()), "run")
    return scored.groupBy("learning_rate", "batch_size", "epochs").agg(
        F.count("*").alias("scored"),
        F.round(F.avg("accuracy"), 6).alias("mean_accuracy"),
        F.round(F.max("accuracy"), 6).alias("best_accuracy"),
    )
