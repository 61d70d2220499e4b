"""Teacher responses, fan-out, splits and streaming."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import conversations as C
from tessella.operators import splits as D
from tessella.operators import teacher as T
from tessella.streaming import jobs

PACK = {
    "translation": {"literal_en": "l", "idiomatic_en": " i "},
    "morphosyntax": [
        {"form": "a", "lemma": "a", "upos": "X", "feats": None, "head": 0, "deprel": "root"},
        {"form": "b", "lemma": "b", "upos": "X", "feats": "", "head": 1, "deprel": "dep"},
        {"form": "c", "lemma": "c", "upos": "X", "feats": "Case=Nom", "head": 1, "deprel": "dep"},
    ],
    "transforms": [{"type": f"T{i}", "source_latin": f"s$1{i}", "target_latin": f" t{i} "} for i in range(1, 5)],
    "main_clause": {"clause": " m "},
    "complement_info": {"has_complements": True, "complements": []},
}


def packs(spark, *bodies):
    rows = [(1, i, f"sentence {i}", json.dumps(b) if isinstance(b, dict) else b) for i, b in enumerate(bodies, 1)]
    df = spark.createDataFrame(rows, "paragraph_index long, sentence_index long, sentence string, body string")
    return T.parse_teacher_packs(df.drop("body"), df.drop("sentence").filter("body IS NOT NULL"))


def test_fan_out(spark):
    no = {**PACK, "complement_info": {"has_complements": False, "complements": ["x"]}}
    yes = {**PACK, "complement_info": {"has_complements": True, "complements": ["x", "y"]}}
    missing = {**PACK, "complement_info": {"has_complements": True}}
    found = {r.id: r for r in T.fan_out_items(packs(spark, PACK, no, yes, missing)[0]).collect()}
    assert len(found) == 4 * 7
    assert found["p0001.s01.t.translate"].target == "i"
    assert found["p0001.s01.a.morphosyntax"].target.split("\n") == [
        "a\ta\tX\t_\t0\troot", "b\tb\tX\t_\t1\tdep", "c\tc\tX\tCase=Nom\t1\tdep"
    ]
    assert sorted(i for i in found if i.startswith("p0001.s01.x")) == [f"p0001.s01.x.0{i}" for i in (1, 2, 3)]
    first = found["p0001.s01.x.01"]
    assert (first.prompt, first.target, first.meta.transform) == (
        "Task: Rewrite in Latin as instructed (T1). Input: s$11", "t1", "T1"
    )
    assert found["p0001.s01.c.main_clause"].target == "m"
    targets = [found[f"p0001.s0{i}.c.complements"].target for i in (1, 2, 3, 4)]
    assert targets == [
        "Yes. Complements identified: ", "No complements are identified.", "Yes. Complements identified: x, y",
        "Yes. Complements identified: ",
    ]
    assert T.fan_out_items(packs(spark, PACK)[0], max_transforms=0).count() == 4


def test_pack_rejects(spark):
    wrong_type = {**PACK, "morphosyntax": [{**PACK["morphosyntax"][0], "head": "2"}]}
    no_clause = {k: v for k, v in PACK.items() if k != "main_clause"}
    null_item = {**PACK, "transforms": [None]}
    good, rejects = packs(spark, PACK, wrong_type, no_clause, '{"translation":', None, null_item)
    assert [r.sentence_index for r in good.collect()] == [1]
    assert {r.sentence_index: (r.path, r.reason) for r in rejects.collect()} == {
        2: ("$.morphosyntax[0].head", "text, not an integer"),
        3: ("$.main_clause", "missing"),
        4: (None, "not one JSON value"),
        5: (None, "no response"),
        6: ("$.transforms[0]", "null, not an object"),
    }


def test_prompts_take_any_character(spark):
    text = r"a $1 \1 {sentence} {paragraph} {{x}} %s"
    df = spark.createDataFrame([(1, 1, text, text)], "paragraph_index long, sentence_index long, sentence string, text string")
    for made in (T.teacher_requests(df), T.segment_requests(df)):
        assert f"<<<\n{text}\n>>>\n" in made.first().user
    assert "{lang, text}" in T.segment_requests(df).first().user


@pytest.mark.parametrize("n", [1, 7, 1000, 25_000])
@pytest.mark.parametrize("preset", ["local", "hub", "holdout", "validation_only"])
def test_split_sizes_are_exact(spark, n, preset):
    first, second, name = D.SPLIT_PRESETS[preset]
    found = {r.split: r["rows"] for r in D.split_sizes(D.preset_split(spark.range(n), ["id"], preset)).collect()}
    aside = math.ceil(first * n)
    inner = math.ceil(second * aside) if second else 0
    expected = {name: aside - inner, "val": inner, "train": n - aside}
    if name == "val":
        expected = {"val": aside, "train": n - aside}
    assert found == {k: v for k, v in expected.items() if v}


def test_split_does_not_depend_on_partitions(spark):
    one, many = (
        D.preset_split(spark.range(2000).repartition(p), ["id"], "local").orderBy("id").collect() for p in (1, 64)
    )
    assert one == many
    other = D.preset_split(spark.range(2000), ["id"], "local", seed=7).orderBy("id").collect()
    assert one != other


def test_split_walks_digest_prefixes(spark, monkeypatch):
    """The histogram walk finds the same cut as reading the digests directly."""
    direct = D.preset_split(spark.range(3000), ["id"], "local").orderBy("id").collect()
    monkeypatch.setattr(D, "COLLECT_ROWS", 2)
    assert D.preset_split(spark.range(3000), ["id"], "local").orderBy("id").collect() == direct


def test_split_refuses_copies(spark):
    with pytest.raises(ValueError, match="not unique"):
        D.hash_split(spark.range(100).withColumn("id", F.lit(1)), ["id"], 0.5)


def test_format_dispatch(spark):
    pair = spark.createDataFrame([("p", "t")], "prompt string, target string")
    assert C.format_for_training(pair).columns == ["prompt", "completion"]
    chat = C.format_for_training(pair, local=True)
    assert [(m.role, m.content) for m in chat.first().messages] == [("user", "p"), ("assistant", "t")]
    assert C.format_for_training(chat) is chat
    other = spark.range(1)
    with pytest.warns(UserWarning, match="not recognised"):
        assert C.format_for_training(other) is other


def test_stream_take(spark, tmp_path):
    rows = [{"text": f"t{i}"} if i % 4 else {"n": i} for i in range(40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    for take, kept in ((8, 6), (0, 0), (None, 30)):
        stream = spark.readStream.schema("text string, n int").json(str(tmp_path / "in"))
        out = str(tmp_path / f"out{take}")
        jobs.append_available(jobs.stream_take(stream, take), out, str(tmp_path / f"state{take}"))
        assert spark.read.schema("text string").json(out).count() == kept


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    def arrive(name, indexes):
        (tmp_path / "in").mkdir(exist_ok=True)
        rows = [{"paragraph_index": 1, "sentence_index": i, "sentence": "s", "body": json.dumps(PACK) if i % 3 else "{"} for i in indexes]
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")

    def run():
        made = jobs.items_from_responses(jobs.response_stream(spark, str(tmp_path / "in")))
        jobs.append_available(made, str(tmp_path / "out"), str(tmp_path / "state"))
        return spark.read.schema("id string").json(str(tmp_path / "out"))

    arrive("a.json", range(1, 7))
    assert run().count() == 4 * 7
    arrive("b.json", range(7, 10))
    found = run()
    assert found.count() == 6 * 7 and found.distinct().count() == 6 * 7
