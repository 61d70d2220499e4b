"""Exams, sweeps and training logs."""

import math
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessella.operators import exams as E
from tessella.operators import logs as L
from tessella.operators import sweeps as W
from tessella.plans import queries as Q
from tessella.sources import files


def exam(spark):
    rows = [("x", "1", "q1", {"b": "two", "a": "one"}, "a"), ("x", "2", "q2", {"a": "1"}, "b")]
    return spark.createDataFrame(rows, "exam_name string, id string, question string, options map<string,string>, correct_answer string")


def predictions(spark, raws):
    return spark.createDataFrame(
        [("r", "x", str(i), raw) for i, raw in enumerate(raws, 1)], "run string, exam_name string, id string, raw string"
    )


def test_prompts_keep_option_order(spark):
    made = exam(spark).withColumn(
        "options", F.when(F.col("id") == "1", F.create_map(F.lit("b"), F.lit("two"), F.lit("a"), F.lit("one"))).otherwise(F.col("options"))
    )
    assert E.exam_prompts(made).filter("id = '1'").first().user == "\nQuestion: q1\nb) two\na) one\nAnswer:"


def test_first_char(spark):
    found = E.match_answers(predictions(spark, ["a) x", "A", "", "(b)", " d "])).orderBy("id").collect()
    assert [r.predicted_answer for r in found] == ["a", "?", "?", "?", "d"]


def test_verdicts_replace_the_first_char(spark):
    answers = predictions(spark, ["a", "a", "a", "a"])
    judged = predictions(spark, [" B ", "e", None]).filter("id <> '4'")
    found = E.match_answers(answers, judged).orderBy("id").collect()
    assert [r.predicted_answer for r in found] == ["b", "?", "?", "?"]


def test_scores_and_results(spark, tmp_path):
    scored = E.score(exam(spark), E.match_answers(predictions(spark, ["a", "a"])))
    assert sorted((r.id, r.is_correct) for r in scored.collect()) == [("1", True), ("2", False)]
    summary = E.exam_accuracy(scored).first()
    assert (summary.correct, summary.total, summary.accuracy) == (1, 2, 0.5)
    files.write_results(scored, str(tmp_path / "out"))
    assert (tmp_path / "out" / "run=r" / "exam_name=x").is_dir()
    assert E.exam_accuracy(scored.filter("id = '9'")).count() == 0


def test_best_artifacts(spark):
    paths = [
        "base/s_sweep_1/checkpoint-9/w", "base/s_sweep_1/checkpoint-40/w",
        "base/sweep_2/checkpoint-90/w", "base/sweep_2/final_model/w",
        "base/sweep_3/logs/w", "base/sweep_4/final_model", "base/other/final_model/w", "base/sweep_5/my-checkpoint-7/w",
    ]
    found = W.best_artifacts(spark.createDataFrame([(p,) for p in paths], "path string"), "base").orderBy("run").collect()
    assert [(r.run, r.artifact) for r in found] == [("s_sweep_1", "checkpoint-40"), ("sweep_2", "final_model")]


def test_ranking(spark):
    runs = spark.createDataFrame([("sweep_lr1e-06_bs2_ep1",), ("b_sweep",), ("c_sweep",), ("d_sweep",)], "run string")
    accuracy = spark.createDataFrame(
        [("sweep_lr1e-06_bs2_ep1", "x", 1, 2, 0.5), ("c_sweep", "x", 2, 2, 1.0), ("b_sweep", "x", 1, 2, 0.5)],
        "run string, exam_name string, correct long, total long, accuracy double",
    )
    summary = W.sweep_summary(runs, accuracy)
    board = W.leaderboard(summary).orderBy("rank").collect()
    assert [(r.rank, r.run) for r in board] == [(1, "c_sweep"), (2, "b_sweep"), (3, "sweep_lr1e-06_bs2_ep1"), (4, "d_sweep")]
    assert (board[3].success, board[3].error) == (False, "no predictions")
    assert [r.run for r in W.leaderboard_top(summary, 2).orderBy("rank").collect()] == ["c_sweep", "b_sweep"]
    counts = W.sweep_counts(summary).first()
    assert (counts.total_models, counts.successful, counts.failed) == (4, 3, 1)
    assert W.sweep_metrics(summary).first().mean_accuracy == round(2 / 3, 6)
    params = W.run_hyperparams(runs).collect()
    assert [(r.learning_rate, r.batch_size, r.epochs) for r in params] == [(1e-06, 2, 1)]
    assert [r.scored for r in W.sweep_by_param(summary).collect()] == [1]


def log(spark, rows):
    return spark.createDataFrame(rows, "run string, pos long, step long, loss double, eval_loss double")


def test_series(spark):
    made = L.loss_series(log(spark, [("r", 0, 1, 2.0, None), ("r", 1, 2, None, 3.0), ("r", 2, 3, 4.0, 5.0), ("r", 3, None, 1.0, 1.0), ("r", 4, 5, None, None)]))
    assert sorted((r.series, r.step, r.value) for r in made.collect()) == [("eval", 2, 3.0), ("eval", 3, 5.0), ("train", 1, 2.0), ("train", 3, 4.0)]
    with pytest.raises(ValueError, match="neither"):
        L.require_series(L.loss_series(log(spark, [("r", 0, 1, None, None)])))


def smooth(values, k):
    return [sum(values[max(0, i - k + 1) : i + 1]) / (i + 1 - max(0, i - k + 1)) for i in range(len(values))]


@pytest.mark.parametrize("k", [1, 3, 5])
@pytest.mark.parametrize("block_rows", [4, 5, 50, 100_000])
def test_moving_average(spark, k, block_rows):
    """A hot run reaches over many blocks; every block limit has its context."""
    rows = [("hot" if i % 3 else f"r{i % 5}", i, i, float(i * i % 17), float(i % 7) if i % 4 == 0 else None) for i in range(400)]
    made = L.moving_average(L.loss_series(log(spark, rows)), k, block_rows=block_rows).collect()
    found, expected = {}, {}
    for r in sorted(made, key=lambda r: r.pos):
        found.setdefault((r.run, r.series), []).append(r.smoothed)
        expected.setdefault((r.run, r.series), []).append(r.value)
    assert sum(map(len, found.values())) == 500
    for key, values in expected.items():
        window = L.eval_window(k) if key[1] == "eval" else k
        assert found[key] == pytest.approx(smooth(values, window))


def test_golden_smoothing_and_perplexity(spark):
    made = L.moving_average(L.loss_series(log(spark, [("r", i, i, float(i + 1), None) for i in range(4)])), 3)
    assert [r.smoothed for r in made.orderBy("pos").collect()] == [1, 1.5, 2, 3]
    found = spark.createDataFrame([(0.0,), (1000.0,), (None,)], "x double").select(L.perplexity(F.col("x")).alias("p")).collect()
    assert [r.p for r in found] == [1.0, math.inf, None]


def test_questions_are_not_shuffled_for_every_run(spark):
    """Question texts join last; null ids and repeated ids stay as they were."""
    exam = spark.createDataFrame([("e", "1", "q1", "a"), ("e", None, "q0", "b"), ("e", "2", "q2", "c"), ("e", "2", "q3", "d")], "exam_name string, id string, question string, correct_answer string")
    matched = spark.createDataFrame([(f"r{i}", "e", x, x, "c") for i in range(3) for x in ("1", "2")], "run string, exam_name string, id string, predicted_raw string, predicted_answer string")
    scored = E.score(exam, matched)
    wanted = [("1", "q1", "1", "c", "a", False), (None, "q0", None, "?", "b", False), ("2", "q2", "2", "c", "c", True), ("2", "q3", "2", "c", "d", False)]
    columns = ("run", "id", "question", "predicted_raw", "predicted_answer", "correct", "is_correct")
    assert Counter(tuple(r[c] for c in columns) for r in scored.collect()) == Counter((f"r{i}", *w) for i in range(3) for w in wanted)
    plan = E.score(exam, matched)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("Exchange hashpartitioning(run" in a and "question" in b for a, b in zip(plan, plan[1:]))


def test_results_are_made_once(spark, monkeypatch):
    """What is written several times does not join and group the predictions each time."""
    seen = []
    monkeypatch.setattr(Q.files, "write_sweep", lambda rows, *_: seen.append(rows))
    monkeypatch.setattr(Q.files, "write_run_results", lambda rows, *_: seen.append(rows))
    for run in (Q.sweep_results, Q.run_results):
        try:
            run(spark, SMALL)
        except AnalysisException:
            pass  # nothing was written that could be read
    assert len(seen) == 5 and not any("Join" in rows._jdf.queryExecution().optimizedPlan().toString() for rows in seen)
