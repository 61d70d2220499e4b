"""Log records of any keys, tool calls as JSON, and a stream limit that outlives a stop."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import render
from tessella.operators import exams as E
from tessella.operators import logs as L
from tessella.sources import files
from tessella.streaming import jobs

# Training logs

HISTORY = [
    {"step": 20, "loss": 1.5, "learning_rate": 1e-05},
    {"step": 40.0, "loss": 2, "more": {"loss": 7}},
    {"step": 40, "eval_loss": math.nan, "eval_held_out_loss": 3, "eval_runtime": 4.5},
    {"loss": 9.0},
    {"step": 60, "loss": None, "note": "x"},
    {"step": 80, "loss": "1.25"},
    {"step": "90", "loss": 1.0},
    {"step": 90.5, "loss": 1.0},
    {"step": True, "loss": 1.0},
    7,
    None,
    {},
    {"step": 12345678901, "loss": 10**20, "eval_loss": math.inf},
]


def write_log(path, run, body):
    folder = path / run
    folder.mkdir(parents=True)
    (folder / "trainer_state.json").write_text(body if isinstance(body, str) else json.dumps(body))


def plain(value):
    """A number as a double; the text 'nan' so that it compares."""
    if isinstance(value, bool) or not isinstance(value, int | float):
        return None
    return "nan" if math.isnan(value) else float(value)


def test_log_records_of_any_keys(spark, tmp_path):
    write_log(tmp_path, "one", {"epoch": 3.0, "log_history": HISTORY})
    write_log(tmp_path, "empty", {"log_history": []})
    write_log(tmp_path, "none", {"epoch": 1})
    write_log(tmp_path, "null", {"log_history": None})
    records = files.read_log_records(spark, f"{tmp_path}/*")
    assert [(r.run, r.pos) for r in records.orderBy("pos").collect()] == [("one", i) for i in range(len(HISTORY))]
    wanted = []
    for pos, record in enumerate(HISTORY):
        step = plain(record.get("step")) if isinstance(record, dict) else None
        if step is not None and step == int(step):
            wanted += [(pos, int(step), k, plain(v)) for k, v in record.items() if k != "step" and plain(v) is not None]
    found = L.log_metrics(records)
    got = [(r.pos, r.step, r.metric, plain(r.value)) for r in found.collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert {r.metric for r in L.eval_losses(found).collect()} == {"eval_loss", "eval_held_out_loss"}
    series = L.loss_series(files.read_training_logs(spark, f"{tmp_path}/*"))
    assert sorted((r.series, r.pos, r.step) for r in series.collect()) == [
        ("eval", 2, 40), ("eval", 12, 12345678901), ("train", 0, 20), ("train", 1, 40), ("train", 12, 12345678901),
    ]


def test_a_broken_log_is_an_error(spark, tmp_path):
    write_log(tmp_path, "cut", '{"log_history": [{"step": 1, "loss": 1.0}')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_training_logs(spark, f"{tmp_path}/*").collect()


# Exams, configurations and preprompts


def test_configured_exams(spark, tmp_path):
    for name, text in (("one.txt", " a\n"), ("two.v2.txt", "b"), ("empty.txt", ""), ("other.txt", "o")):
        (tmp_path / name).write_text(text)
    texts = files.read_preprompts(spark, f"{tmp_path}/*.txt")
    assert sorted(map(tuple, texts.collect())) == [("one", " a\n"), ("other", "o"), ("two.v2", "b")]
    entries = [("e", "x/one.txt"), ("e", "one.txt"), ("e", "two.v2.txt"), ("f", "x/none.txt"), ("f", "empty.txt"), ("f", None), ("gone", "one.txt"), ("gone", "none.txt"), (None, "one.txt")]
    configs = spark.createDataFrame(entries, "exam_name string, preprompt_file string").withColumn("max_new_tokens", F.lit(5))
    exams = spark.createDataFrame([("e",), ("e",), ("f",), ("unused",)], "exam_name string")
    usable, faults = E.configured(configs, texts, exams)
    got = sorted((r.exam_name, r.preprompt_file, r.preprompt, r.max_new_tokens) for r in usable.collect())
    assert got == [("e", "one.txt", " a\n", 5), ("e", "two.v2.txt", "b", 5), ("e", "x/one.txt", " a\n", 5)]
    assert sorted(map(tuple, faults.collect()), key=str) == sorted(
        [("f", f, "no preprompt file, or an empty one") for f in ("x/none.txt", "empty.txt", None)] + [("gone", "one.txt", "no exam file"), ("gone", "none.txt", "no exam file"), (None, "one.txt", "no exam file")],
        key=str,
    )


def test_two_preprompt_files_of_one_name_are_an_error(spark):
    texts = spark.createDataFrame([("one", "a"), ("one", "b"), ("two", "c")], "name string, preprompt string")
    configs = spark.createDataFrame([("e", "one.txt")], "exam_name string, preprompt_file string")
    with pytest.raises(Exception, match="several preprompt files named one"):
        E.configured(configs, texts, configs)[0].collect()


def test_exams_named_by_folder(spark, tmp_path):
    for folder in ("exam=a-1", "plain.b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part-0.json").write_text(json.dumps([{"id": "1", "question": "q", "options": {"b": "x", "a": "y"}, "correct_answer": "a"}]))
    read = files.read_exams(spark, f"{tmp_path}/*", "folder").withColumn("options", F.map_keys("options"))
    assert sorted(map(tuple, read.collect())) == [(n, "1", "q", ["b", "a"], "a") for n in ("a-1", "plain.b")]


# Tool calls


def calls_of(spark, texts):
    frame = spark.createDataFrame([(texts,)], "calls array<string>")
    return [tuple(c) for c in frame.select(render.json_calls(F.col("calls")).alias("c")).first().c or []]


ARGUMENTS = [
    {},
    [],
    {"z": 1, "a": [1, 2.5, {"deep": {"b": [], "a": {}}}]},
    {"text": 'comma, colon: "quoted", [bracket] \\ back\\"slash', "key, with: marks": True},
    {"lines": "a\nb\tc\r\b\f", "control": "\x01\x0b\x1f", "not control": "\\u001F \\\\u000B", "greek": "λόγος, é", "wide": "😀: ,"},
    None,
    12,
    True,
    [None, "x", [[]]],
    {"😀": ["𝄞a😀", {"🜁": "\\ud83d\\ude00 as text 😀"}]},
    {"long": 'a, "b": \\' * 20_000},
    {str(i): {"v": [i, i]} for i in range(2_000)},
]


@pytest.mark.parametrize("value", ARGUMENTS, ids=range(len(ARGUMENTS)))
def test_arguments_are_laid_out_as_json(spark, value):
    wanted = ("f", json.dumps(value, ensure_ascii=False))
    bare, spaced = json.dumps({"name": "f", "arguments": value}), json.dumps({"arguments": value, "name": "f"}, indent=1, ensure_ascii=False)
    wrapped = json.dumps({"type": "function", "function": {"name": "f", "arguments": value}}, separators=(",", ":"))
    assert calls_of(spark, [bare, spaced, wrapped]) == [wanted] * 3


def test_forms_of_calls(spark):
    text = '{"x" : 1}'
    for function in ({}, None, [], "", False, 0):
        assert calls_of(spark, [json.dumps({"function": function, "name": "g", "arguments": text})]) == [("g", text)]
    assert calls_of(spark, ['{"name": null, "arguments": ""}', '{"arguments": "a"}']) == [("", ""), ("", "a")]
    assert calls_of(spark, []) == [] and calls_of(spark, None) == []


@pytest.mark.parametrize("call", ["nonsense", "", None, "[]", '{"name": "f"}', '{"function": {"name": "f"}, "arguments": {}}', '{"name": "f", "arguments": {"a": 1, "a": 2}}'])
def test_broken_calls_are_errors(spark, call):
    with pytest.raises(Exception, match="not a tool call"):
        calls_of(spark, [call])


def test_json_calls_in_chatml(spark):
    calls = ['{"function": {"name": "f", "arguments": {"b":[1,2],"a":"x:y"}}}', '{"name":"g","arguments":"{}"}']
    schema = "messages array<struct<role:string,content:string,tool_calls:array<string>>>"
    frame = spark.createDataFrame([([("assistant", "c", calls)],)], schema)
    typed = F.transform("messages", lambda m: F.struct(m["role"], m["content"], render.json_calls(m["tool_calls"]).alias("tool_calls")))
    text = frame.select(typed.alias("messages")).select(render.text_of(render.chatml(F.col("messages"), has_tool_calls=True)).alias("t")).first().t
    assert text == (
        '<|im_start|>assistant\nc\n<tool_call>\n{"name": "f", "arguments": {"b": [1, 2], "a": "x:y"}}\n</tool_call>\n'
        '<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n'
    )


# Streams

ROWS = "id BIGINT, text STRING"


def taken_from(spark, path, take, per_batch=1):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", per_batch).json(f"{path}/in")
    jobs.take_available(stream, f"{path}/out", f"{path}/state", take)
    kept = sorted(r.id for r in spark.read.schema(ROWS).json(f"{path}/out/rows").select("id", "text").collect())
    return kept, spark.read.schema("n BIGINT").json(f"{path}/out/taken").agg(F.sum("n")).first()[0]


def feed(spark, path, first, last, parts):
    ids = spark.range(first, last, 1, parts)
    ids.select("id", F.when(F.col("id") % 5 != 0, F.lit("t")).alias("text")).write.mode("append").json(f"{path}/in")


def test_take_goes_on_after_a_restart(spark, tmp_path):
    """The limit counts over runs, rows without a text included, whatever the batches."""
    feed(spark, tmp_path, 0, 100, 4)
    kept, taken = taken_from(spark, tmp_path, 150)
    assert taken == 100 and kept == [i for i in range(100) if i % 5]
    feed(spark, tmp_path, 100, 200, 4)
    kept, taken = taken_from(spark, tmp_path, 150, 2)
    assert taken == 150 and len(kept) == 120 and len(set(kept)) == 120 and set(kept) < set(range(200))
    feed(spark, tmp_path, 200, 300, 2)
    assert taken_from(spark, tmp_path, 150) == (kept, 150)


@pytest.mark.parametrize("after", ["rows", "taken"])
def test_a_batch_that_is_run_again_counts_once(spark, tmp_path, after, monkeypatch):
    """Stopped after a folder of a batch is written: the batch replaces it."""
    from pyspark.sql.readwriter import DataFrameWriter

    feed(spark, tmp_path, 0, 90, 3)
    written, stops = DataFrameWriter.json, []

    def stop(self, path, *args, **kwargs):
        written(self, path, *args, **kwargs)
        if path.endswith(f"{after}/batch=1") and not stops:
            stops.append(path)
            raise RuntimeError("stopped")

    monkeypatch.setattr(DataFrameWriter, "json", stop)
    with pytest.raises(Exception, match="stopped"):
        taken_from(spark, tmp_path, 70)
    kept, taken = taken_from(spark, tmp_path, 70)
    assert stops and taken == 70 and len(kept) == 56 == len(set(kept))


@pytest.mark.parametrize("take", [0, 1, 37, 99, 100, None])
def test_take_of_one_batch(spark, tmp_path, take):
    feed(spark, tmp_path, 0, 100, 7)
    kept, taken = taken_from(spark, tmp_path, take, 100)
    assert taken == min(100 if take is None else take, 100) and len(kept) == len(set(kept)) <= taken


def test_take_of_nothing(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.json(f"{tmp_path}/in")
    assert taken_from(spark, tmp_path, 10) == ([], 0)


def test_first_rows_in_partition_order(spark):
    rows = spark.range(0, 1000, 1, 9).filter("id < 111 OR id > 400")  # some partitions are empty
    for n in (0, 1, 110, 111, 112, 500, 10_000):
        assert sorted(r.id for r in jobs._first_rows(rows, n).collect()) == ([*range(111), *range(401, 1000)])[:n]
