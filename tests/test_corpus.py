"""Paragraphs, records, items: golden rows and real files."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions.text import collapse, right_strip, strip, words
from tessella.operators import paragraphs as P
from tessella.operators.ordering import ordinals, rank_rows, take_slice
from tessella.sources import corpus, files, items, lines


def line_table(spark, texts, file="a.txt", chunk=2):
    rows = [(file, i // chunk, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file string, chunk long, pos long, value string")


NUMBERED = ["pre", "1. a", " b", "", "2.", "3.14 x", "1.c"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_numbered_paragraphs(spark, chunk):
    found = P.numbered_paragraphs(line_table(spark, NUMBERED, chunk=chunk)).orderBy("ordinal").collect()
    assert [(r.label, r.text) for r in found] == [("1", "a\n b"), ("3", "14 x"), ("1", "c")]
    assert [r.id for r in found] == ["rec0001", "rec0003", "rec0001"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_blank_line_paragraphs(spark, chunk):
    texts = "\na\n \n\nb\nc\n\n".split("\n")
    found = P.blank_line_paragraphs(line_table(spark, texts, chunk=chunk)).orderBy("ordinal").collect()
    assert [(r.id, r.text) for r in found] == [("rec0001", "a"), ("rec0002", "b\nc")]


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_choice_per_file(spark, chunk):
    """A label without any text after it does not make a file a numbered one."""
    plain = line_table(spark, ["x", "", "y"], "plain.txt", chunk)
    numbered = line_table(spark, ["x", "1. y", "z"], "numbered.txt", chunk)
    below = line_table(spark, ["1.", "", "z"], "below.txt", chunk)
    bare = line_table(spark, ["x", "", "7.", " "], "bare.txt", chunk)
    every = plain.unionByName(numbered).unionByName(below).unionByName(bare)
    found = {(r.file, r.id, r.text) for r in P.text_paragraphs(every).collect()}
    assert found == {
        ("plain.txt", "rec0001", "x"),
        ("plain.txt", "rec0002", "y"),
        ("numbered.txt", "rec0001", "y\nz"),
        ("below.txt", "rec0001", "z"),
        ("bare.txt", "rec0001", "x"),
        ("bare.txt", "rec0002", "7."),
    }


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_known_form_of_a_file(spark, chunk):
    """A line that begins with an address looks like a label; a file known to have none is cut by blank lines."""
    texts = ["x", "", "10.0.0.1 y", "", "z"]
    every = line_table(spark, texts, "plain.txt", chunk).unionByName(line_table(spark, texts, "open.txt", chunk))
    known = F.when(F.col("file") == "plain.txt", F.lit(False))
    found = {(r.file, r.id, r.text) for r in P.text_paragraphs(every, known).collect()}
    blank = {("plain.txt", "rec0001", "x"), ("plain.txt", "rec0002", "10.0.0.1 y"), ("plain.txt", "rec0003", "z")}
    assert found == blank | {("open.txt", "rec0010", "0.0.1 y\n\nz")}
    mixed = every.unionByName(line_table(spark, ['{"id": "j", "text": "t"}'], "a.jsonl", chunk))
    assert {(r.file, r.id, r.text) for r in corpus.records_from_lines(mixed, known).collect()} == found | {("a.jsonl", "j", "t")}


def by_hand(texts):
    """Numbered paragraphs by a plain loop."""
    import re

    out, label, body = [], None, []
    for t in [*texts, None]:
        m = re.match(r"^\s*(\d+)\.\s*(.*)$", t) if t is not None else None
        if t is None or m:
            if label is not None and "\n".join(body).strip():
                out.append((label, "\n".join(body).strip()))
            if m:
                label, body = str(int(m[1])), [m[2]]
        elif label is not None:
            body.append(t)
    return out


def test_numbered_paragraphs_against_loop(spark):
    import random

    rng = random.Random(7)
    pool = ["", " ", "a b", "1. x", "2.", " 3.y", "\t12. z", "4 .no", "c.", "x 5. y", "6.7. q"]
    texts = [rng.choice(pool) for _ in range(600)]
    for chunk in (1, 7, 64, 1000):
        found = P.numbered_paragraphs(line_table(spark, texts, chunk=chunk)).orderBy("ordinal").collect()
        assert [(r.label, r.text) for r in found] == by_hand(texts)


def test_json_records(spark):
    texts = ['{"text":"x"}', "", '{"n":1,"z":"q","a":"r"}', '{"id":"k","text":""}', '{"id":5,"text":3,"b":"c"}']
    numbered = lines.number_lines(line_table(spark, texts))
    found = corpus.json_records(numbered).orderBy("ordinal").collect()
    assert [(r.id, r.text) for r in found] == [("rec0001", "x"), ("rec0003", "q"), ("k", ""), ("5", "c")]
    bad = lines.number_lines(line_table(spark, ['{"text":"x"}', '{"n":1}', "[1]"]))
    with pytest.raises(Exception, match="no string field"):
        corpus.json_records(bad).collect()
    kept = corpus.json_records(bad, "quarantine").filter("reason IS NOT NULL").collect()
    assert sorted(r.ordinal for r in kept) == [2, 3]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"text":"one"}\n{"id":"k","text":"two"}\n', encoding="utf-8")
    (tmp_path / "B.TXT").write_bytes("1. first\r\nmore\r\n\r\n2. second\r\n".encode())
    found = {(r.id, r.text) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert found == {("rec0002", "one"), ("k", "two"), ("rec0001", "first\nmore"), ("rec0002", "second")}
    assert corpus.read_corpus_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "c.csv").write_text("x\n", encoding="utf-8")
    with pytest.raises(Exception, match="unsupported input format"):
        corpus.read_corpus(spark, str(tmp_path)).collect()


def test_line_numbers_over_file_blocks(spark, tmp_path):
    """Small file blocks: numbers stay exact over block limits and files."""
    for name, count in (("a", 5000), ("b", 3000)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{i}\n" for i in range(1, count + 1)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        scanned = lines.scan_lines(spark, str(tmp_path))
        assert scanned.select("file", "chunk").distinct().count() > 10
        for numbered in (lines.number_scanned(scanned), lines.number_lines(scanned)):
            assert numbered.count() == 8000
            assert numbered.filter(F.col("value").cast("long") != F.col("line_no")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_plain_text_blocks(spark, tmp_path):
    from tessella.operators import blocks

    (tmp_path / "a.txt").write_bytes(b"one  two\r\n\n three\xff")
    (tmp_path / "b.txt").write_bytes("four \u3000 five\n".encode())
    source = corpus.read_plain_text(spark, str(tmp_path))
    made = blocks.token_blocks(source, 2).orderBy("block_id").collect()
    assert [r.tokens for r in made] == [["one", "two"], ["three", "four"]]


ITEMS = [
    '{"task":"transform","prompt":" p ","target":"t","id":"own"}',
    "",
    '{"task":"translate","prompt":null,"target":"t"}',
    '{"task":"transform","prompt":true,"target":1.5}',
    '{"task":"transform","prompt":"  ","target":"t"}',
    '{"task":"contrast_judge","prompt":12,"target":100000000.0}',
]


def test_items(spark):
    numbered = lines.number_lines(line_table(spark, ITEMS, "i.jsonl"))
    found = items.items_from_lines(numbered, None, True).collect()
    assert {(r.id, r.prompt, r.target) for r in found} == {
        ("own", "p", "t"),
        ("item000003", "None", "t"),
        ("item000004", "True", "1.5"),
        ("item000006", "12", "100000000.0"),
    }
    tasks, keep = items.ITEM_PRESETS["three_tasks"]
    assert len(items.items_from_lines(numbered, tasks, keep).collect()) == 3


@pytest.mark.parametrize(
    ("line", "reason"),
    [('{"prompt":"p"}', "missing"), ('{"prompt":', "invalid JSON"), ('{"prompt":["p"],"target":"t"}', "list or object")],
)
def test_item_errors(spark, line, reason):
    """A bad line stops the read even if the task filter would have dropped it."""
    numbered = lines.number_lines(line_table(spark, [ITEMS[0], line], "i.jsonl"))
    with pytest.raises(Exception, match=reason):
        items.items_from_lines(numbered, ["transform"]).collect()
    assert items.items_from_lines(numbered, None, False, "quarantine").count() == 1
    rejects = items.item_rejects(numbered).collect()
    assert [r.line_no for r in rejects] == [2] and reason in rejects[0].reason


def test_read_items_file(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text("\n".join(ITEMS), encoding="utf-8")
    assert items.read_items(spark, str(tmp_path)).count() == 4
    (tmp_path / "i.jsonl").write_text("\n\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no valid items"):
        items.read_items(spark, str(tmp_path))


def test_exam_log_and_config_files(spark, tmp_path):
    exam = [{"id": 1, "question": "q", "options": {"b": "2", "a": "1"}, "correct_answer": "a"}]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "final.2025.json").write_text(json.dumps(exam, indent=1), encoding="utf-8")
    row = files.read_exams(spark, str(tmp_path / "e")).withColumn("options", F.map_entries("options")).first()
    assert (row.exam_name, [tuple(o) for o in row.options]) == ("final.2025", [("b", "2"), ("a", "1")])
    for run, state in (("r1", {"log_history": [{"step": 1, "loss": 2.0}, {"epoch": 1}]}), ("r2", {})):
        (tmp_path / "l" / run).mkdir(parents=True)
        (tmp_path / "l" / run / "state.json").write_text(json.dumps(state), encoding="utf-8")
    log = files.read_training_logs(spark, str(tmp_path / "l" / "*")).orderBy("pos").collect()
    assert [(r.run, r.pos, r.step, r.loss) for r in log] == [("r1", 0, 1, 2.0), ("r1", 1, None, None)]
    config = {"benchmarks": [{"exam_path": "x/a.json", "preprompt_file": "p", "max_new_tokens": 5, "temperature": 0.0}]}
    (tmp_path / "c.json").write_text(json.dumps(config), encoding="utf-8")
    assert files.read_exam_configs(spark, str(tmp_path / "c.json")).first().exam_name == "a"


def test_strip_like_python(spark):
    texts = ["\x1c a b 　", " x\x85", "  ", "", "é​ ", "\ta\x0bb\n\nc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    rows = df.select(c, strip(c).alias("s"), right_strip(c).alias("r"), collapse(c).alias("c"), words(c).alias("w")).collect()
    for r in rows:
        assert (r.s, r.r, r.c, r.w) == (r.t.strip(), r.t.rstrip(), " ".join(r.t.split()), r.t.split())


@pytest.mark.parametrize(("n", "rows"), [(-1, 4), (2, 2), (0, 0), (9, 5), (-9, 0)])
def test_take_slice(spark, n, rows):
    df = spark.createDataFrame([(i, str(i)) for i in range(5)], "k long, v string")
    assert [r.k for r in take_slice(df, n, "k").orderBy("k").collect()] == list(range(5))[:n]
    assert take_slice(df, n, "k").count() == rows


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_positions_do_not_depend_on_partitions(spark, parts):
    df = spark.range(3000).withColumn("g", (F.col("id") % 3 == 0).cast("string")).repartition(parts)
    by_id = ordinals(df, "id")
    assert by_id.filter("ordinal <> id + 1").count() == 0 and by_id.count() == 3000
    ranked = rank_rows(df, ["g", F.col("id").desc()])
    expected = sorted(((str(i % 3 == 0).lower(), -i) for i in range(3000)))
    assert [(r.g, -r.id) for r in ranked.orderBy("ordinal").collect()] == expected
    sparse = df.select((F.col("id") * 1_000_003 + 5).alias("id"))
    assert ordinals(sparse, "id").filter("ordinal <> (id - 5) / 1000003 + 1").count() == 0
