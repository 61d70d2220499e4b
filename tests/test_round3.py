"""Tokenizers as parameters, blocks of ids, sinks that keep earlier runs, errors per run, streams with rejects."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import arrays as A
from tessella.functions import render
from tessella.functions.text import DEFAULT_TOKENIZER, WORD_TOKENIZER, Tokenizer
from tessella.operators import blocks as B
from tessella.operators import conversations as C
from tessella.operators import lengths as K
from tessella.operators import sweeps as W
from tessella.operators import teacher as T
from tessella.sources import files
from tessella.streaming import jobs

# Tokenizers


def plain_mask(segments, counts, pattern):
    """A flag per match, set if any of its characters is in a segment that counts."""
    text = "".join(t for t, _ in segments)
    inside = [c for (t, _), c in zip(segments, counts) for _ in t]
    return [int(any(inside[m.start() : m.end()])) for m in re.finditer(pattern, text)]


def conversations():
    draw = random.Random(3)
    pieces = ["word", " ", "a b", "", "\n", "é日本", "<|x|>", "end.", "　", "  two  spaces ", "x" * 300]
    made = [[(draw.choice(pieces), draw.random() < 0.4) for _ in range(draw.randint(0, 12))] for _ in range(60)]
    return [*made, [], [("", True)], [("only", False)], [("a", True), ("b", False), ("c", True)], [("word " * 3_000, False), ("tail" * 2, True)], [("x y", True)] * 700]


@pytest.mark.parametrize("mode", ["assistant", "completion", "all"])
def test_masks_of_tokens_across_borders(spark, mode):
    rows = [(i, segments, "".join(t for t, _ in segments)) for i, segments in enumerate(conversations())]
    frame = spark.createDataFrame(rows, "id int, segments array<struct<text:string,train:boolean>>, text string")
    for tokenizer, pattern in ((WORD_TOKENIZER, r"\S+"), (Tokenizer("[a-z]{1,3}|[^a-z]"), r"[a-z]{1,3}|[^a-z]")):
        got = {r.id: r.mask for r in C.loss_mask(frame, mode, tokenizer).collect()}
        for i, segments, _ in rows:
            marked = [j for j, (t, train) in enumerate(segments) if train and t]
            counts = {
                "assistant": [train for _, train in segments], "all": [True] * len(segments),
                "completion": [bool(marked) and j == marked[-1] for j in range(len(segments))],
            }[mode]
            assert got[i] == plain_mask(segments, counts, pattern), (i, segments)


def test_additive_and_placed_masks_agree(spark):
    """The built-in tokenizer never spans a border of a rendered conversation, so both ways give one mask."""
    turns = [(1, 0, "user", "Hi there, you"), (1, 1, "assistant", "Yes. No!"), (2, 0, "system", "Be kind"), (2, 1, "user", "a"), (2, 2, "assistant", "")]
    frame = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    made = C.rendered(C.assemble(frame), render.llama(F.col("messages")))
    placed = Tokenizer(DEFAULT_TOKENIZER.pattern)
    assert {r.conv_id: r.mask for r in C.loss_mask(made).collect()} == {r.conv_id: r.mask for r in C.loss_mask(made, tokenizer=placed).collect()}
    counted = K.rendered_token_counts(made, tokenizer=WORD_TOKENIZER)
    assert {r.conv_id: r.num_tokens for r in counted.collect()} == {r.conv_id: len(r.text.split()) for r in made.collect()}
    with pytest.raises(ValueError, match="unknown loss mode"):
        C.loss_mask(made, "some", WORD_TOKENIZER)


def test_array_helpers(spark):
    lists = [[], [5], list(range(255)), list(range(256)), list(range(257)), [1] * 2_000]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "id int, v array<bigint>")
    got = {r.id: r for r in A.with_running_sums(frame, "s", F.col("v")).select("id", "s", F.transform(F.array(*map(F.lit, (-1, 0, 100, 10_000))), lambda x: A.count_below(F.col("s"), x)).alias("n")).collect()}
    for i, v in enumerate(lists):
        sums = [sum(v[: k + 1]) for k in range(len(v))]
        assert got[i].s == sums and got[i].n == [sum(s < x for s in sums) for x in (-1, 0, 100, 10_000)]


# Ids


def test_id_blocks_are_the_ids_of_the_token_blocks(spark):
    texts = spark.createDataFrame([(None, "z z"), *[(i * 1000, " ".join(f"w{j % (i + 2)}" for j in range(i * 7))) for i in range(40)]], "key long, text string")
    vocab = B.build_vocabulary(texts)
    ids = {r.token: r.id for r in vocab.collect()}
    for length in (1, 8, 64):
        blocks = {r.block_id: r.tokens for r in B.token_blocks(texts, length).collect()}
        got = B.id_blocks(B.encode(texts, vocab), length)
        assert got.schema["input_ids"].dataType.simpleString() == "array<int>"
        assert {r.block_id: (r.input_ids, r.attention_mask) for r in got.collect()} == {b: ([ids[t] for t in x], [1] * length) for b, x in blocks.items()}
    shown = B.preview_id_blocks(B.id_blocks(B.encode(texts, vocab), 8), vocab, n=2, max_chars=10, show_ids=True).collect()
    assert sorted(r.block_id for r in shown) == [0, 1] and all(len(r.ids) == 8 and r.preview.endswith(" …") for r in shown)


def test_batches_of_id_rows(spark):
    vocab = spark.createDataFrame([(0, "<|eot|>"), (1, "the"), (2, "end")], "id long, token string")
    batch = spark.createDataFrame([(1, [[1, 2], [], [0, 2]]), (2, []), (None, [[0]])], "key int, ids array<array<int>>")
    got = {(r.key, r.row): r.text for r in B.decode(batch, vocab, skip_special=True).collect()}
    assert got == {(1, 0): "the end", (1, 1): "", (1, 2): "end", (None, 0): ""}
    flat = spark.createDataFrame([(1, [1, 0]), (2, [])], "key int, ids array<bigint>")
    assert {r.key: r.text for r in B.decode(flat, vocab).collect()} == {1: "the <|eot|>", 2: ""}
    assert B.decode(spark.createDataFrame([(1, [9])], "key int, ids array<int>"), vocab, unknown="?").first().text == "?"
    with pytest.raises(ValueError, match="one or two dimensional"):
        B.decode(spark.createDataFrame([(1, [[[1]]])], "key int, ids array<array<array<int>>>"), vocab)


def test_tokens_stay_in_their_task(spark):
    """With a vocabulary that is broadcast, texts are dealt out once and tokens are not shuffled."""
    texts = spark.range(50).select(F.col("id").alias("key"), F.concat_ws(" ", F.lit("a"), F.col("id").cast("string")).alias("text"))
    vocab = B.build_vocabulary(texts).cache()
    plan = B.encode(texts, vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryTableScan")[0].count("Exchange hashpartitioning") == 1


# Sinks


def read(spark, schema, path):
    return spark.read.schema(schema).json(str(path))


def test_runs_keep_each_other(spark, tmp_path):
    schema = "id string, is_correct boolean, run string, exam_name string"
    a, b, again = (spark.createDataFrame([(i, True, run, "e") for i in ids], schema) for run, ids in (("a", "12"), ("b", "3"), ("a", "4")))
    for rows in (a, b):
        files.write_results(rows, str(tmp_path))
    assert sorted(map(tuple, read(spark, schema, tmp_path).select("run", "id").collect())) == [("a", "1"), ("a", "2"), ("b", "3")]
    files.write_results(again, str(tmp_path))
    assert sorted(map(tuple, read(spark, schema, tmp_path).select("run", "id").collect())) == [("a", "4"), ("b", "3")]


def test_run_results_and_sweeps_keep_each_other(spark, tmp_path):
    accuracy = spark.createDataFrame([("r1", "e", 1, 2, 0.5), ("001", "e", 2, 2, 1.0)], "run string, exam_name string, correct long, total long, accuracy double")
    configs = spark.createDataFrame([("r1", "e", "p", 20, 0.0)], "run string, exam_name string, preprompt string, max_new_tokens long, temperature double")
    artifacts = spark.createDataFrame([("r1", "final_model")], "run string, artifact string")
    made = W.run_results(accuracy, configs, artifacts, "base", "t1")
    files.write_run_results(made, f"{tmp_path}/runs")
    files.write_run_results(made.filter("run = 'r1'").withColumn("benchmark_timestamp", F.lit("t2")), f"{tmp_path}/runs")
    got = {r.run: (r.model_path, r.benchmark_timestamp, r.preprompt) for r in read(spark, files.RUN_RESULT_SCHEMA, f"{tmp_path}/runs").collect()}
    assert got == {"r1": ("base/r1/final_model", "t2", "p"), "001": (None, "t1", None)}
    summary = W.sweep_summary(spark.createDataFrame([("r1",), ("001",), ("x",)], "run string"), accuracy)
    for sweep, stamp in (("one", "a"), ("two", "b"), ("one", "c")):
        files.write_sweep(summary, W.sweep_counts(summary), f"{tmp_path}/sweeps", sweep, stamp)
    manifest = read(spark, files.MANIFEST_SCHEMA, f"{tmp_path}/sweeps/manifest")
    assert {r.sweep: (r.timestamp, r.total_models, r.successful, r.failed) for r in manifest.collect()} == {"one": ("c", 3, 2, 1), "two": ("b", 3, 2, 1)}
    assert read(spark, files.SWEEP_RESULT_SCHEMA, f"{tmp_path}/sweeps/results").count() == 6


def test_errors_of_runs(spark):
    configs = spark.createDataFrame([("a", "e"), ("a", "f"), ("b", "e"), ("c", "e"), ("c", "f"), ("d", "g")], "run string, exam_name string")
    answered = spark.createDataFrame([("a", "e", 10), ("a", "f", 3), ("c", "f", 4)], "run string, exam_name string, n long")
    sizes = spark.createDataFrame([("e", 10), ("f", 4)], "exam_name string, n long")
    crashes = spark.createDataFrame([("b", None, "load", "boom"), ("c", "e", "answer", "late"), ("c", "e", "judge", "down"), ("z", None, "load", "no run")], "run string, exam_name string, stage string, error string")
    errors = W.run_errors(configs, answered, sizes, crashes)
    assert sorted(map(tuple, errors.collect())) == [
        ("a", "f", "answer", "1 of 4 questions unanswered"), ("b", "e", "load", "boom"), ("c", "e", "answer", "late"), ("c", "e", "judge", "down"),
    ]
    accuracy = spark.createDataFrame([("a", "e", 1, 10, 0.1)], "run string, exam_name string, correct long, total long, accuracy double")
    summary = W.sweep_summary(configs.select("run").distinct(), accuracy, errors=errors)
    assert {r.run: r.error for r in summary.collect()} == {"a": None, "b": "boom", "c": "down; late", "d": "no predictions"}


# Streams


def test_judged_stream_goes_on_after_a_stop(spark, tmp_path):
    """Stopped between its two sinks: run again, neither loses or repeats a row."""
    pack = {
        "translation": {"literal_en": "a", "idiomatic_en": "b"}, "morphosyntax": [], "transforms": [], "main_clause": {"clause": "c"},
        "complement_info": {"has_complements": False},
    }
    bodies = [json.dumps(pack), "{", None, json.dumps({**pack, "transforms": [5]})]
    rows = [(p, s, "x", bodies[(p + s) % 4]) for p in range(1, 21) for s in range(1, 6)]
    frame = spark.createDataFrame(rows, "paragraph_index long, sentence_index long, sentence string, body string").repartition(6)
    frame.write.json(f"{tmp_path}/in")
    stops = []

    def stop(name, number):
        if name == "items" and number == 1 and not stops:
            stops.append(number)
            raise RuntimeError("stopped")

    stream = jobs.response_stream(spark, f"{tmp_path}/in", 2)
    with pytest.raises(Exception, match="stopped"):
        jobs.append_judged(stream, f"{tmp_path}/out", f"{tmp_path}/state", written=stop)
    jobs.append_judged(stream, f"{tmp_path}/out", f"{tmp_path}/state", written=stop)
    good, bad = T.parse_teacher_packs(frame.drop("body"), frame.select("paragraph_index", "sentence_index", "body"))
    schema = "paragraph_index long, sentence_index long, path string, reason string"
    got = read(spark, schema, f"{tmp_path}/out/rejects").select("paragraph_index", "sentence_index", "path", "reason")
    assert stops == [1] and sorted(map(str, got.collect())) == sorted(map(str, bad.collect())) and got.count() == 75
    items = read(spark, files.ITEM_SCHEMA, f"{tmp_path}/out/items").select("id", "task")
    assert sorted(map(tuple, items.collect())) == sorted(map(tuple, T.fan_out_items(good).select("id", "task").collect()))
    jobs.append_judged(stream, f"{tmp_path}/out", f"{tmp_path}/state")  # nothing new
    assert read(spark, schema, f"{tmp_path}/out/rejects").count() == 75


def test_streams_write_compressed_files(spark, tmp_path):
    body = json.dumps({"translation": 1})
    spark.createDataFrame([(1, 1, "s", body)], jobs.RESPONSE_SCHEMA).write.json(f"{tmp_path}/in", compression=jobs.COMPRESSION)
    jobs.append_judged(jobs.response_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    jobs.append_available(jobs.response_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/same", f"{tmp_path}/same-state")
    for folder in ("out/rejects/batch=0", "same"):
        parts = [p.name for p in (tmp_path / folder).glob("part-*")]
        assert parts and all(name.endswith(".json.gz") for name in parts)
    assert spark.read.json(f"{tmp_path}/out/rejects").count() == spark.read.json(f"{tmp_path}/same").count() == 1
