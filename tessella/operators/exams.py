"""Multiple-choice exams: prompts, answers of many model runs, verdicts and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import wording
from tessella.functions.text import strip
from tessella.operators.ordering import join_checked

# Answer labels, and the mark for "no match".
LABELS = ("a", "b", "c", "d")
NO_MATCH = "?"


def option_lines(options: Column) -> Column:
    return F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(") "), e["value"]))


def exam_prompts(exam: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform(option_lines(F.col("options")), lambda x: F.concat(x, F.lit("\n"))), "")
    user = F.concat(F.lit("\nQuestion: "), "question", F.lit("\n"), lines, F.lit("Answer:"))
    return exam.select("exam_name", "id", user.alias("user"))


def eval_requests(prompts: DataFrame, configs: DataFrame) -> DataFrame:
    """One request per configured (run, exam) and question of that exam.

    An equi-join on the exam. ``configs`` is a list of model runs, measured before it is broadcast.
    """
    asked = configs.select(
        "run", "exam_name", strip(F.col("preprompt")).alias("system"), "max_new_tokens", "temperature"
    )
    return join_checked(prompts, asked, ["exam_name"], ["id"])


def configured(configs: DataFrame, preprompts: DataFrame, exams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of configurations with their preprompt, ready for ``eval_requests``, and the faulty entries.

    ``configs`` has (exam_name, preprompt_file, ...), ``preprompts`` (name, preprompt), named like the file
    without folders and extension, ``exams`` at least exam_name. An entry whose exam or preprompt file is
    missing or not named is a fault (exam_name, preprompt_file, reason); the others go on. An empty file is
    like a missing one. Repeated entries stay, files of one name must be one.
    """
    stem = F.regexp_extract("preprompt_file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    known = exams.select("exam_name").distinct().withColumn("_exam", F.lit(True))
    texts = preprompts.groupBy(F.col("name").alias("_stem")).agg(
        F.when(F.count("*") == 1, F.first("preprompt")).otherwise(F.raise_error(F.concat(F.lit("several preprompt files named "), F.col("_stem")))).alias("preprompt")
    )
    found = configs.withColumn("_stem", stem).join(texts, "_stem", "left").join(known, "exam_name", "left")
    reason = F.when(F.col("_exam").isNull(), "no exam file").when(F.col("preprompt").isNull(), "no preprompt file, or an empty one")
    judged = found.withColumn("reason", reason).drop("_stem", "_exam")
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull()).select(
        "exam_name", "preprompt_file", "reason"
    )


def first_char(raw: Column) -> Column:
    letter = F.substring(strip(raw), 1, 1)
    return F.when(letter.isin(*LABELS), letter).otherwise(F.lit(NO_MATCH))


def judge_requests(predictions: DataFrame, exam: DataFrame, model: str = wording.JUDGE_MODEL) -> DataFrame:
    """Judge texts for every prediction. The option text is built once per question."""
    options = exam.select("exam_name", "id", F.array_join(option_lines(F.col("options")), "\n").alias("_options"))
    joined = join_checked(predictions, options, ["exam_name", "id"], ["run"])
    head, rest = wording.JUDGE_USER.split("{answer}")
    middle, tail = rest.split("{options}")
    user = F.concat(F.lit(head), strip(F.col("raw")), F.lit(middle), "_options", F.lit(tail))
    return joined.select(
        "run", "exam_name", "id", F.lit(model).alias("model"), F.lit(wording.JUDGE_SYSTEM).alias("system"),
        user.alias("user"),
    )


def verdict(raw: Column) -> Column:
    """A judge answer as a label; anything else, and a failed call, is no match."""
    cleaned = F.lower(strip(raw))
    return F.when(cleaned.isin(*LABELS, NO_MATCH), cleaned).otherwise(F.lit(NO_MATCH))


def match_answers(predictions: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """``predicted_answer`` from the first character, or from judge verdicts where they are given."""
    stripped = predictions.withColumn("predicted_raw", strip(F.col("raw")))
    if verdicts is None:
        return stripped.withColumn("predicted_answer", first_char(F.col("raw"))).drop("raw")
    # One verdict per prediction: both sides are large, so neither may be broadcast on an estimate.
    named = verdicts.withColumnRenamed("raw", "_verdict").hint("merge")
    judged = stripped.join(named, ["run", "exam_name", "id"], "left")
    return judged.withColumn("predicted_answer", verdict(F.col("_verdict"))).drop("raw", "_verdict")


def score(exam: DataFrame, matched: DataFrame, carry: Sequence[str] = ("question",)) -> DataFrame:
    """Result rows: every question of an exam for every run that answered any of it.

    A question without an answer is no match and not correct. Only the key and the columns of
    ``carry`` are taken from the exam.
    """
    key = exam.select("exam_name", "id", F.col("correct_answer").alias("correct"), *carry)
    runs = matched.select("run", "exam_name").distinct()
    # What is carried is as long as a question and there is a row for every run: it joins last, so that it moves once.
    asked = join_checked(key.select("exam_name", "id").distinct() if carry else key, runs, ["exam_name"], ["id"])
    answers = matched.select("run", "exam_name", "id", "predicted_raw", "predicted_answer").hint("merge")
    joined = asked.join(answers, ["run", "exam_name", "id"], "left")
    if carry:
        texts = key.withColumnsRenamed({"exam_name": "_exam", "id": "_id"}).hint("merge")
        joined = joined.join(texts, (F.col("exam_name") == F.col("_exam")) & F.col("id").eqNullSafe(F.col("_id")))
    answer = F.coalesce("predicted_answer", F.lit(NO_MATCH))
    return joined.select(
        "run", "exam_name", "id", *carry, "predicted_raw", answer.alias("predicted_answer"), "correct",
        F.coalesce(answer == F.col("correct"), F.lit(False)).alias("is_correct"),
    )


def exam_accuracy(scored: DataFrame) -> DataFrame:
    totals = scored.groupBy("run", "exam_name").agg(
        F.sum(F.col("is_correct").cast("long")).cast("long").alias("correct"), F.count("*").alias("total")
    )
    return totals.withColumn("accuracy", F.try_divide("correct", "total"))
