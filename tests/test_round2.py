"""Cases the registered queries do not meet: ties, nulls, sparse keys, gaps in answers, strict lines."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import render
from tessella.operators import blocks, exams, ordering, sweeps


def next_fit(lengths, limit):
    bins, bin_, used = {}, 0, 0
    for key, n in sorted(lengths, key=lambda x: (-min(x[1], limit), x[0])):
        n = min(n, limit)
        if used + n > limit:
            bin_, used = bin_ + 1, 0
        used += n
        bins[key] = bin_
    return bins


@pytest.mark.parametrize("limit", [1, 7, 64])
def test_packing_is_next_fit(spark, limit):
    lengths = [(i, (i * 37) % 71) for i in range(400)] + [(1_000, 0), (1_001, 500)]
    frame = spark.createDataFrame(lengths, "key bigint, num_tokens bigint")
    got = {r.key: r.bin for r in blocks.pack_sequences(frame, limit).collect()}
    assert got == next_fit(lengths, limit)
    sharded = blocks.pack_sequences(frame, limit, shards=3).collect()
    for shard in range(3):
        mine = [(r.key, r.num_tokens) for r in sharded if r.shard == shard]
        assert {r.key: r.bin for r in sharded if r.shard == shard} == next_fit(mine, limit)
    assert blocks.pack_sequences(frame.limit(0), limit).count() == 0


def test_packing_keeps_bins_when_rows_are_added_behind(spark):
    frame = spark.createDataFrame([(i, 300 - i % 3) for i in range(300)] + [(999, 1)], "key bigint, num_tokens bigint")
    few, more = (blocks.pack_sequences(f, 300).collect() for f in (frame.filter("key < 300"), frame))
    assert {r.key: r.bin for r in few} == {r.key: r.bin for r in more if r.key < 300}


@pytest.mark.parametrize("n", [0, 2, 3, -1, -2, -9])
@pytest.mark.parametrize("top", [10_000, 0])
def test_slices_with_ties_and_nulls(spark, monkeypatch, n, top):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, "e")], "key int, v string")
    whole = [r.v for r in ordering.take_slice(frame, 5, "key").collect()]
    monkeypatch.setattr(ordering, "TOP_ROWS", top)
    assert sorted(r.v for r in ordering.take_slice(frame, n, "key").collect()) == sorted(whole[:n] if n >= 0 else whole[: max(0, 5 + n)])


def test_positions_with_null_keys(spark):
    frame = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b")], "key bigint, v string")
    assert {r.v: r.ordinal for r in ordering.ordinals(frame, "key").collect()} == {"n": 1, "a": 2, "b": 3}


@pytest.mark.parametrize("keys", [[0, 1, 2], [5, 10**12, 10**15], [None, 3, 4]])
def test_blocks_of_sparse_and_null_keys(spark, keys):
    frame = spark.createDataFrame(list(zip(keys, ["a b c", "d", "e f"])), "key bigint, text string")
    got = {r.block_id: r.tokens for r in blocks.token_blocks(frame, 2).collect()}
    assert got == {0: ["a", "b"], 1: ["c", "d"], 2: ["e", "f"]}


def test_encodings_keep_every_row(spark):
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "<|x|>")], "id bigint, token string")
    texts = spark.createDataFrame([(1, "a b"), (2, ""), (3, "a z")], "key bigint, text string")
    assert {r.key: r.ids for r in blocks.encode(texts, vocab, unknown=9).collect()} == {1: [0, 1], 2: [], 3: [0, 9]}
    with pytest.raises(Exception, match="not in the vocabulary"):
        blocks.encode(texts, vocab).collect()
    ids = spark.createDataFrame([(1, [0, 1]), (2, []), (3, [2]), (4, [0, 9])], "key bigint, ids array<bigint>")
    got = {r.key: r.text for r in blocks.decode(ids, vocab, skip_special=True, unknown="?").collect()}
    assert got == {1: "a b", 2: "", 3: "", 4: "a ?"}
    with pytest.raises(Exception, match="not in the vocabulary"):
        blocks.decode(ids, vocab).collect()


def test_two_dimensional_ids_decode_row_by_row(spark):
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "id bigint, token string")
    nested = spark.createDataFrame([(1, [[0, 1], [1, 0], []])], "key bigint, ids array<array<bigint>>")
    got = {(r.key, r.row): r.text for r in blocks.decode(blocks.as_rows(nested, "key", "ids"), vocab).collect()}
    assert got == {(1, 0): "a b", (1, 1): "b a", (1, 2): ""}


def test_unanswered_questions_count(spark):
    exam = spark.createDataFrame([("e", i, "a") for i in range(4)] + [("f", 0, "b")], "exam_name string, id int, correct_answer string")
    answers = spark.createDataFrame([("r", "e", 0, "a"), ("r", "e", 1, "a) x"), ("s", "f", 0, "c")], "run string, exam_name string, id int, raw string")
    scored = exams.score(exam, exams.match_answers(answers), carry=())
    got = {(r.run, r.exam_name): (r.correct, r.total, r.accuracy) for r in exams.exam_accuracy(scored).collect()}
    assert got == {("r", "e"): (2, 4, 0.5), ("s", "f"): (0, 1, 0.0)}
    assert scored.filter("predicted_raw is null and predicted_answer = '?' and not is_correct").count() == 2


def test_base_path_is_no_pattern(spark):
    paths = spark.createDataFrame([("res+1/a_sweep/final_model/x",), ("ress1/b_sweep/final_model/x",), ("res+1/c_sweep/checkpoint-9",)], "path string")
    assert [tuple(r) for r in sweeps.best_artifacts(paths, "res+1").collect()] == [("a_sweep", "final_model")]


def test_null_content_is_an_empty_turn(spark):
    frame = spark.createDataFrame([([("user", "hi"), ("assistant", None)],)], "m array<struct<role:string,content:string>>")
    text = frame.select(render.text_of(render.llama(F.col("m"))).alias("t")).first().t
    assert text.endswith("<|start_header_id|>assistant<|end_header_id|>\n\n<|eot_id|>")


LINES = {
    '{"prompt":"p","target":"t"}': None,
    "{'prompt':'p','target':'t'}": "invalid JSON",
    '{"prompt":"p","target":"t"} xyz': "invalid JSON",
    '{"prompt":"p","target":"t"}}': "invalid JSON",
    '{"prompt":"p","target":"t"}]': "invalid JSON",
    '{"prompt":"p","target":"t"},{"prompt":"p","target":"t"}': "invalid JSON",
    '[{"prompt":"p","target":"t"}]': "invalid JSON",
    '{"prompt":"p","target":"t"': "invalid JSON",
    '{"prompt":"p"}': "missing 'prompt' or 'target' field",
}


def test_lines_must_be_one_object(spark):
    from tessella.sources import items

    frame = spark.createDataFrame([("f", i, line) for i, line in enumerate(LINES, 1)], "file string, line_no bigint, value string")
    got = {r.line_no: r.reason for r in items.item_rejects(frame).collect()}
    assert {line: got.get(i) for i, line in enumerate(LINES, 1)} == LINES


def test_explicit_null_id_stays(spark):
    from tessella.sources import corpus

    lines = ['{"id":null,"text":"x"}', '{"text":"y"}', '{"id":"k","text":"z"}']
    frame = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines, 1)], "file string, line_no bigint, value string")
    assert [r.id for r in corpus.json_records(frame).orderBy("ordinal").collect()] == [None, "rec0002", "k"]


def test_labels_of_any_script_and_length(spark):
    from tessella.operators.paragraphs import numbered_paragraphs

    rows = [("\u0663. a", "3"), ("99999999999999999999. b", "9" * 20), ("007. c", "7"), ("\U0001d7d8\U0001d7d9. d", "1"), ("000. e", "0")]
    frame = spark.createDataFrame([("f", 0, i, line) for i, (line, _) in enumerate(rows)], "file string, chunk long, pos long, value string")
    found = numbered_paragraphs(frame).orderBy("ordinal").collect()
    assert [(r.label, r.id) for r in found] == [(n, "rec" + n.zfill(4)) for _, n in rows]


def test_short_and_empty_texts_are_questions(spark, tmp_path):
    from tessella.plans import views

    spark.createDataFrame([(1, "one"), (2, ""), (3, None), (4, "a b c d e")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.id: r.user for r in exams.exam_prompts(views.exam(spark, str(tmp_path))).collect()}
    assert found["d1"] == "\nQuestion: one\na) one\nAnswer:"
    assert found["d2"] == found["d3"] == "\nQuestion: \nAnswer:"
    assert found["b1"] == "\nQuestion: x y\na) x\nb) y\nAnswer:"
    assert "d) d\nAnswer" in found["d4"] and len(found) == 5


def test_long_conversations_keep_their_turns_apart(spark, tmp_path):
    from tessella.plans import views

    turns = [(1, t, "user" if t % 2 else "assistant", f"1.{t}") for t in range(150)] + [(2, 1, "user", "2.1"), (2, 3, "user", "2.3")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.id: (r.prompt, r.target) for r in views.item_pairs(spark, str(tmp_path)).collect()}
    assert len(found) == 77 and found["1-101"] == ("1.101", "1.102") and found["1-149"] == ("1.149", None)
    assert found["2-1"] == ("2.1", None) and found["2-3"] == ("2.3", None)
