"""Chat formats, masks and token lengths."""

import math
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tessella.functions import render
from tessella.functions.text import TOKEN_PATTERN
from tessella.operators import conversations as C
from tessella.operators import lengths as K

MESSAGE = "array<struct<role:string,content:string>>"


def one(spark, messages, kind=MESSAGE):
    return spark.createDataFrame([(1, messages)], f"conv_id long, messages {kind}")


def render_one(spark, messages, segments, kind=MESSAGE):
    return C.rendered(one(spark, messages, kind), segments).first()


HEAD = (
    "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
    "Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n"
)


def test_llama(spark):
    row = render_one(spark, [("user", "hi"), ("assistant", " yo ")], render.llama(F.col("messages")))
    answer = "<|start_header_id|>assistant<|end_header_id|>\n\nyo<|eot_id|>"
    assert row.text == HEAD + "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>" + answer
    assert [s.text for s in row.segments if s.train] == [answer]
    row = render_one(
        spark, [("system", " one "), ("system", "two")], render.llama(F.col("messages"), add_generation_prompt=True)
    )
    assert row.text == (
        HEAD + "one<|eot_id|><|start_header_id|>system<|end_header_id|>\n\ntwo<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n\n"
    )


TOOL_MESSAGE = "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>"


def test_chatml_tools(spark):
    calls = [("f", "{}"), ("g", '{"x": 1}')]
    row = render_one(
        spark,
        [("user", " u ", None), ("tool", "1", None), ("tool", None, None), ("assistant", "", calls), ("assistant", "c", calls[:1])],
        render.chatml(F.col("messages"), has_tool_calls=True),
        TOOL_MESSAGE,
    )
    assert row.text == (
        "<|im_start|>user\n u <|im_end|>\n"
        "<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n\n</tool_response><|im_end|>\n"
        '<|im_start|>assistant\n<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call>\n<tool_call>\n{"name": "g", "arguments": {"x": 1}}\n</tool_call><|im_end|>\n'
        '<|im_start|>assistant\nc\n<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call><|im_end|>\n'
    )
    marked = [s.text for s in row.segments if s.train]
    assert len(marked) == 2 and marked[1].startswith("c\n<tool_call>") and marked[1].endswith("</tool_call>")


def test_chatml_system_and_tools_header(spark):
    text = render_one(spark, [("system", "s"), ("user", "u")], render.chatml(F.col("messages"), ['{"name": "f"}'])).text
    assert text.startswith("<|im_start|>system\ns\n\n# Tools\n\n") and '<tools>\n{"name": "f"}\n</tools>' in text
    assert text.count("<|im_start|>system") == 1
    assert render_one(spark, [("system", "s")], render.chatml(F.col("messages"))).text == "<|im_start|>system\ns<|im_end|>\n"


def test_inst(spark):
    row = render_one(spark, [("user", "u"), ("assistant", "a"), ("system", "s")], render.inst(F.col("messages"), "2025-01-02"))
    assert row.text.startswith("<s>[SYSTEM_PROMPT]You are") and "The current date is 2025-01-02." in row.text
    assert row.text.endswith("[/SYSTEM_PROMPT][INST]u[/INST]a</s>[SYSTEM_PROMPT]s[/SYSTEM_PROMPT]")
    with pytest.raises(Exception, match="roles are supported"):
        render_one(spark, [("tool", "x")], render.inst(F.col("messages"), "2025-01-02"))


def test_inst_blocks(spark):
    kind = "array<struct<role:string,content:string,blocks:array<struct<type:string,text:string>>>>"
    shaped = render.inst(F.col("messages"), "2025-01-02", has_blocks=True)
    rows = [("system", None, [("text", "s")]), ("user", None, [("text", "look "), ("image", None)]), ("assistant", None, [("text", "a")])]
    assert render_one(spark, rows, shaped, kind).text == "<s>[SYSTEM_PROMPT]s[/SYSTEM_PROMPT][INST]look [IMG][/INST]a</s>"
    with pytest.raises(Exception, match="text and image"):
        render_one(spark, [("user", None, [("audio", None)])], shaped, kind)


def test_fallback(spark):
    row = render_one(spark, [(None, "x"), ("tool", None)], render.fallback(F.col("messages")))
    assert row.text == "<|user|>\nx\n<|tool|>\n\n"


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


TURNS = [
    (1, 0, "system", "\xa0sys one "), (1, 1, "user", "hi <|eot_id|> there"), (1, 2, "assistant", " a-b "),
    (2, 5, "user", "   "), (2, 7, "system", "first after a blank"), (2, 9, "assistant", "c"), (2, 11, "system", "late"),
    (3, 0, "user", "x <|"), (3, 1, "assistant", "<"),
]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_counts_per_turn_equal_counts_of_the_text(spark, parts):
    source = turns(spark, TURNS).repartition(parts)
    whole = C.rendered(C.assemble(source), render.llama(F.col("messages")))
    expected = {r.conv_id: r.num_tokens for r in K.rendered_token_counts(whole).collect()}
    assert {r.conv_id: r.num_tokens for r in K.llama_token_counts(source).collect()} == expected
    masks = {r.conv_id: r.mask for r in C.loss_mask(whole).collect()}
    assert {k: len(m) for k, m in masks.items()} == expected
    assert {r.conv_id: r.assistant_tokens for r in K.llama_token_counts(source).collect()} == {k: sum(m) for k, m in masks.items()}


def test_a_conversation_with_a_third_of_all_turns(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"),
    )
    counts = K.llama_token_counts(rows)
    assert counts.count() == 6001
    assert counts.filter("conv_id = 0").first().num_tokens > 3000 * 3


def test_default_tokens_like_python(spark):
    import regex

    text = "<|eot_id|>Ça va? 12-ab_c <|x 日本語 é"
    found = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(TOKEN_PATTERN), F.lit(0))).first()[0]
    assert found == regex.findall(TOKEN_PATTERN, text)


def profile(spark, values, percentiles=()):
    return K.length_profile(spark.createDataFrame([(v,) for v in values], "num_tokens long"), percentiles)


def test_length_reports(spark):
    values = list(range(1, 101))
    p = profile(spark, values, [97.0])
    row = K.length_summary(p).first()
    assert (row.n, row.min_tokens, row.max_tokens, row.p50) == (100, 1, 100, 50.5)
    assert row.std_tokens == round(statistics.pstdev(values), 6) and math.isclose(row.p99, 99.01)
    suggested = K.suggest_length(p, 2048).first()
    assert (suggested.max_length, suggested.longer, suggested.capped) == (104, 0, False)
    capped = K.suggest_length(p, 50).first()
    assert (capped.max_length, capped.longer, capped.truncation_rate, capped.capped) == (50, 50, 0.5, True)
    assert K.suggest_length(p, 10_000_000).first().max_length == 104
    assert K.suggest_length(p, None, 97.0).first().max_length == 104
    pad = K.padding_report(p, F.lit(104).cast("long")).first()
    assert pad.padding_tokens == sum(104 - v for v in values)
    assert pad.padding_share == round(pad.padding_tokens / (pad.padding_tokens + sum(values)), 6)


def test_length_histogram(spark):
    bins = K.length_histogram(profile(spark, range(51))).orderBy("bin").collect()
    assert [r.examples for r in bins] == [1] * 49 + [2]
    flat = K.length_histogram(profile(spark, [7, 7, 7])).filter("examples > 0").collect()
    assert [(r.bin, r.bin_start, r.examples) for r in flat] == [(25, 7.0, 3)]


def test_empty_lengths(spark):
    assert K.length_summary(profile(spark, [5]).filter("n > 1")).count() == 0
    empty = spark.createDataFrame([], "num_tokens long")
    assert K.length_summary(K.length_profile(empty)).count() == 0


def test_mask_modes(spark):
    df = C.rendered(one(spark, [("user", "a b"), ("assistant", "c"), ("assistant", "d")]), render.fallback(F.col("messages")))
    assert set(C.loss_mask(df, "all").first().mask) == {1}
    shaped = C.rendered(one(spark, [("user", "a b"), ("assistant", "c"), ("assistant", "d")]), render.chatml(F.col("messages")))
    assert sum(C.loss_mask(shaped, "assistant").first().mask) == 2
    assert sum(C.loss_mask(shaped, "completion").first().mask) == 1
    with pytest.raises(ValueError):
        C.loss_mask(shaped, "x")
    assert re.fullmatch(r"\D+", shaped.first().text)
