"""Responses are judged where they are read; what a query makes of them meets the requests."""

from conftest import SMALL
from pyspark.sql import functions as F

from tessella.functions import validate as S
from tessella.operators import teacher as T
from tessella.plans import views as V
from tessella.plans.queries import QUERIES
from tessella.streaming import jobs


def test_only_what_is_wanted_of_a_pack_meets_the_requests(spark):
    """F12, F14 to F22: bodies are judged before the join, so neither they nor whole packs are shuffled."""
    shuffled = {}
    for name in ("items_translate", "items_morph", "morph_table", "teacher_packs_parsed", "teacher_packs_rejects"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        joined = plan[: plan.index("rightHint")]
        shuffled[name] = [what for what in ("parseJson", "try_variant_get", "schemaOfVariant") if what in joined]
    assert not any(shuffled.values()), shuffled


def test_wanted_columns_and_items_equal_those_of_whole_packs(spark):
    """Requests without a response, null bodies, responses without a request, and two responses to one."""
    sentences = V.sentences(spark, SMALL).select("paragraph_index", "sentence_index", "sentence").filter("paragraph_index < 30")
    responses = V.with_teacher_bodies(V.sentences(spark, SMALL).filter("paragraph_index < 40")).select("paragraph_index", "sentence_index", "body")
    responses = responses.filter("paragraph_index % 5 <> 1").unionByName(responses.filter("paragraph_index % 7 = 2"))
    good, bad = T.parse_teacher_packs(sentences, responses)
    made, _ = T.parse_teacher_packs(sentences, responses, lambda pack: [T.morph_table(pack["morphosyntax"]).alias("table")])
    keys = ["paragraph_index", "sentence_index"]
    plain = good.select(*keys, "sentence", T.morph_table(F.col("pack.morphosyntax")).alias("table"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect()))
    items = T.teacher_items(sentences, responses)
    assert sorted(map(str, items.collect())) == sorted(map(str, T.fan_out_items(good).collect()))
    silent = {(r.paragraph_index, r.sentence_index) for r in bad.collect() if r.reason == "no response"}
    unanswered = {tuple(r) for r in sentences.select(*keys).filter("paragraph_index % 5 = 1 AND paragraph_index % 7 <> 2").collect()}
    assert unanswered and unanswered <= silent
    answers = sentences.select(*keys).join(responses, keys, "left").count()
    assert good.count() + bad.count() == answers


def test_the_walk_takes_every_value_out_once(spark):
    """The walk named each value several times at every level, so its expression and its work grew by a power of the depth."""
    deep = S.Record((S.Field("a", S.TEXT),))
    sizes = []
    for _ in range(5):
        deep = S.Record((S.Field("a", deep),))
        frame = spark.sql("SELECT parse_json('{}') AS v")
        plan = frame.select(deep.fault(F.col("v"), F.lit("$")).alias("f"))._jdf.queryExecution().analyzed().toString()
        sizes.append(plan.count("try_variant_get"))
    assert sizes[-1] - sizes[-2] == sizes[1] - sizes[0], sizes


def test_typed_values_are_parsed_from_the_text(spark):
    """F3 to F9, F12 to F14: a sound body was cast value by value from its VARIANT, and copied with its whole pack."""
    rows = spark.createDataFrame([(1, 1, "{}")], "paragraph_index long, sentence_index long, body string")
    judged = T.judge_bodies(rows, T.PACK, lambda pack: [pack["translation"]["literal_en"].alias("literal_en")])
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert dict(judged.select("pack.*").dtypes) == {"literal_en": "string"}


def test_a_body_cannot_close_what_it_is_parsed_in(spark):
    """An escaped end mark closed the list before its second item, and what stood behind it was lost."""
    sound = '{"translation":{"literal_en":"a","idiomatic_en":"b"},"morphosyntax":[],"transforms":[],"main_clause":{"clause":"c"},"complement_info":{"has_complements":true}}'
    ends = [',"\\u2400end"] junk', ',"e":1} junk', ',"e":1', ',"x":1', "}", ',"b":2', "", ""]
    rows = spark.createDataFrame([(i, sound + end) for i, end in enumerate(ends)], "n int, body string")
    faults = {r.n: r.fault and tuple(r.fault) for r in T.judge_bodies(rows, T.PACK).collect()}
    assert faults == {i: (None, "not one JSON value") if end else None for i, end in enumerate(ends)}


def test_shares_grow_with_the_documents(spark, monkeypatch):
    """F3 to F9, F12 to F14: sixteen shares on eight cores, whatever the size, so what a task sorted outgrew its memory."""
    least = V.teacher_responses(spark, SMALL).rdd.getNumPartitions()
    monkeypatch.setattr(V, "SHARE_BYTES", V.input_bytes(V.table(spark, SMALL, "documents")) // (2 * least))
    assert V.teacher_responses(spark, SMALL).rdd.getNumPartitions() >= 2 * least


def test_a_batch_of_few_files_is_judged_on_all_cores(spark, tmp_path, monkeypatch):
    """files cannot be split, so a batch of three was judged by three tasks; dealt out by the key that had made
    the files, it stayed together all the same."""
    V.response_rows(spark, SMALL).write.json(f"{tmp_path}/in", compression=jobs.COMPRESSION)
    sizes, judge = [], jobs.judge_items

    def seen(rows, *others):
        sizes.append([len(part) for part in rows.select("paragraph_index").rdd.glom().collect()])
        return judge(rows, *others)

    monkeypatch.setattr(jobs, "judge_items", seen)
    jobs.append_judged(jobs.response_stream(spark, f"{tmp_path}/in", 3), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sizes and all(len(parts) >= spark.sparkContext.defaultParallelism and min(parts) > 0 for parts in sizes), sizes
