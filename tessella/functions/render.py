"""Chat formats as column expressions.

Every format turns ``messages ARRAY<STRUCT<role, content, ...>>`` into segments
``ARRAY<STRUCT<text, train>>``: their texts joined are the rendered conversation, and ``train``
marks the parts that count for the loss. Only literals and values are written, no template layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import strip

# Markers and default texts of the chat formats.
LLAMA_BOS = "<|begin_of_text|>"
LLAMA_EOT = "<|eot_id|>"
LLAMA_CUTOFF = "Cutting Knowledge Date: December 2023\n"
LLAMA_DATE = "26 Jul 2024"
CHATML_START = "<|im_start|>"
CHATML_END = "<|im_end|>"
CHATML_TOOLS_HEAD = (
    "# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
CHATML_TOOLS_TAIL = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)
INST_BOS = "<s>"
INST_EOS = "</s>"
INST_SYSTEM = (
    "You are Mistral Small 3, a Large Language Model (LLM) created by Mistral AI, a French startup "
    "headquartered in Paris.\nYour knowledge base was last updated on 2023-10-01. The current date is "
    "{today}.\n\nWhen you're not sure about some information, you say that you don't have the information "
    "and don't make up anything.\nIf the user's question is not clear, ambiguous, or does not provide "
    "enough context for you to accurately answer the question, you do not try to answer it right away and "
    'you rather ask the user to clarify their request (e.g. "What are some good restaurants around me?" '
    '=> "Where are you?" or "When is the next flight to Tokyo" => "Where do you travel from?")'
)

SEGMENTS = "array<struct<text:string,train:boolean>>"


def _segment(text: Column, train: bool | Column = False) -> Column:
    flag = F.lit(train) if isinstance(train, bool) else train
    return F.struct(text.alias("text"), flag.alias("train"))


def _none() -> Column:
    return F.array().cast(SEGMENTS)


def text_of(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def _without_first_system(messages: Column) -> Column:
    has_system = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    return F.when(has_system, F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1)))).otherwise(messages)


def _first_system(messages: Column) -> Column:
    first = F.get(messages, F.lit(0))
    return F.when(first["role"] == "system", F.coalesce(first["content"], F.lit("")))


def llama_header(role: Column) -> Column:
    return F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"))


def llama_opening(system: Column, date: str = LLAMA_DATE) -> Column:
    """The system block, written for every conversation."""
    return F.concat(
        F.lit(LLAMA_BOS),
        llama_header(F.lit("system")),
        F.lit(f"{LLAMA_CUTOFF}Today Date: {date}\n\n"),
        F.coalesce(strip(system), F.lit("")),
        F.lit(LLAMA_EOT),
    )


def llama_turn(role: Column, content: Column) -> Column:
    """A turn whose content is null is an empty turn."""
    return F.concat(llama_header(role), F.coalesce(strip(content), F.lit("")), F.lit(LLAMA_EOT))


def llama(messages: Column, date: str = LLAMA_DATE, add_generation_prompt: bool = False) -> Column:
    parts = [
        F.array(_segment(llama_opening(_first_system(messages), date))),
        F.transform(
            _without_first_system(messages),
            lambda m: _segment(llama_turn(m["role"], m["content"]), m["role"] == "assistant"),
        ),
    ]
    if add_generation_prompt:
        parts.append(F.array(_segment(llama_header(F.lit("assistant")))))
    return F.concat(*parts)


def _chatml_block(role: Column, content: Column) -> Column:
    return F.concat(F.lit(CHATML_START), role, F.lit("\n"), content, F.lit(f"{CHATML_END}\n"))


def _tool_calls(calls: Column, content: Column) -> Column:
    """Calls written after the content, a newline before each but a first one without content."""

    def one(call: Column, i: Column) -> Column:
        gap = F.when((i > 0) | (content != ""), "\n").otherwise("")
        return F.concat(
            gap,
            F.lit('<tool_call>\n{"name": "'),
            call["name"],
            F.lit('", "arguments": '),
            call["arguments"],
            F.lit("}\n</tool_call>"),
        )

    return F.coalesce(F.array_join(F.transform(calls, one), ""), F.lit(""))


# In compact JSON, all up to the next separator that stands outside of strings. Possessive, so that no
# length of text makes the matcher recurse.
_TO_SEPARATOR = r'\G((?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^",:]++)*+)([,:])'
_LETTERED_CONTROLS = [f"{code:04x}" for code in range(32) if not f"{code:04x}".isdigit()]
_SURROGATES = r"\\uD[89AB][0-9A-F]{2}\\uD[C-F][0-9A-F]{2}"
_CALL = "name STRING, arguments STRING, function STRING"


def _as_characters(text: Column) -> Column:
    """Pairs of escapes, which Spark's writer makes of characters beyond 16 bits, as these characters."""

    def joined(piece: Column, pair: Column) -> Column:
        character = F.from_json(F.concat(F.lit('["'), pair, F.lit('"]')), "array<string>")[0]
        return F.concat(piece, F.coalesce(character, F.lit("")))

    pieces = F.split(text, _SURROGATES)  # one more than there are pairs
    return F.array_join(F.zip_with(pieces, F.regexp_extract_all(text, F.lit(_SURROGATES), F.lit(0)), joined), "")


def json_layout(compact: Column) -> Column:
    """Compact JSON with a blank after each separator, all characters but controls as they are, and
    controls in small hex digits."""
    spaced = F.regexp_replace(compact, _TO_SEPARATOR, "$1$2 ")
    small = spaced
    for code in _LETTERED_CONTROLS:
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*+)\\u{code.upper()}", rf"$1\\u{code}")
    plain = F.when(F.contains(spaced, F.lit("\\u00")), small).otherwise(spaced)
    return F.when(F.contains(spaced, F.lit("\\uD")), _as_characters(plain)).otherwise(plain)


def json_calls(calls: Column) -> Column:
    """Tool calls as JSON texts, as the (name, arguments) that ``chatml`` writes.

    A call may lie in ``function``; an empty ``function`` counts as none. Arguments that are a text are
    written as they are, all others as JSON: names in their order, to any depth. A missing or null name
    is empty. A call that is no object, repeats a name or lacks arguments is an error.
    """

    def one(call: Column) -> Column:
        function = F.from_json(call, _CALL)["function"]
        own = F.when(function.isNull() | function.isin("", "{}", "[]", "false", "0"), call).otherwise(function)
        said = F.from_json(own, _CALL)
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(own), "$.arguments", "variant"))
        arguments = (
            F.when(kind == "STRING", said["arguments"])
            .when(kind.isNotNull(), json_layout(F.coalesce(said["arguments"], F.lit("null"))))
            .otherwise(F.raise_error(F.concat(F.lit("not a tool call with arguments: "), F.coalesce(call, F.lit("null")))).cast("string"))
        )
        return F.struct(F.coalesce(said["name"], F.lit("")).alias("name"), arguments.alias("arguments"))

    return F.transform(calls, one)


def chatml(
    messages: Column,
    tools: Sequence[str] = (),
    has_tool_calls: bool = False,
    add_generation_prompt: bool = False,
) -> Column:
    """Tool descriptions come as JSON texts. Runs of tool messages share one user block."""
    system = _first_system(messages)
    if tools:
        listed = "".join("\n" + t for t in tools)
        body = F.concat(
            F.coalesce(F.concat(system, F.lit("\n\n")), F.lit("")),
            F.lit(CHATML_TOOLS_HEAD + listed + CHATML_TOOLS_TAIL),
        )
        opening = F.array(_segment(_chatml_block(F.lit("system"), body)))
    else:
        opening = F.when(
            system.isNotNull(), F.array(_segment(_chatml_block(F.lit("system"), system)))
        ).otherwise(_none())

    def turn(m: Column, i: Column) -> Column:
        role = m["role"]
        content = F.coalesce(m["content"], F.lit(""))
        answer = F.concat(content, _tool_calls(m["tool_calls"], content)) if has_tool_calls else content
        before = F.when(i > 0, F.get(messages, i - 1)["role"])
        after = F.get(messages, i + 1)["role"]
        tool = F.concat(
            F.when(F.coalesce(before == "tool", F.lit(False)), "").otherwise(f"{CHATML_START}user"),
            F.lit("\n<tool_response>\n"),
            content,
            F.lit("\n</tool_response>"),
            F.when(F.coalesce(after == "tool", F.lit(False)), "").otherwise(f"{CHATML_END}\n"),
        )
        return (
            F.when(
                (role == "user") | ((role == "system") & (i > 0)), F.array(_segment(_chatml_block(role, content)))
            )
            .when(
                role == "assistant",
                F.array(
                    _segment(F.lit(f"{CHATML_START}assistant\n")),
                    _segment(answer, True),
                    _segment(F.lit(f"{CHATML_END}\n")),
                ),
            )
            .when(role == "tool", F.array(_segment(tool)))
            .otherwise(_none())
        )

    parts = [opening, F.flatten(F.transform(messages, turn))]
    if add_generation_prompt:
        parts.append(F.array(_segment(F.lit(f"{CHATML_START}assistant\n"))))
    return F.concat(*parts)


def _block_text(block: Column) -> Column:
    return (
        F.when(block["type"] == "text", block["text"])
        .when(block["type"].isin("image", "image_url"), "[IMG]")
        .otherwise(F.raise_error(F.lit("Only text and image blocks are supported in message content!")).cast("string"))
    )


def inst(messages: Column, as_of: str, has_blocks: bool = False) -> Column:
    """Instruction format. ``as_of`` is the date of the default system text.

    With ``has_blocks`` a message may carry ``blocks ARRAY<STRUCT<type, text>>`` instead of content.
    """

    def first_block(m: Column) -> Column:
        if not has_blocks:
            return m["content"]
        return F.coalesce(F.get(m["blocks"], F.lit(0))["text"], m["content"])

    def user_text(m: Column) -> Column:
        if not has_blocks:
            return m["content"]
        return F.coalesce(F.array_join(F.transform(m["blocks"], _block_text), ""), m["content"])

    first = F.get(messages, F.lit(0))
    system = F.when(first["role"] == "system", first_block(first)).otherwise(INST_SYSTEM.replace("{today}", as_of))

    def turn(m: Column) -> Column:
        text = (
            F.when(m["role"] == "user", F.concat(F.lit("[INST]"), user_text(m), F.lit("[/INST]")))
            .when(m["role"] == "system", F.concat(F.lit("[SYSTEM_PROMPT]"), m["content"], F.lit("[/SYSTEM_PROMPT]")))
            .when(m["role"] == "assistant", F.concat(first_block(m), F.lit(INST_EOS)))
            .otherwise(
                F.raise_error(F.lit("Only user, system and assistant roles are supported!")).cast("string")
            )
        )
        return _segment(text)

    opening = F.concat(F.lit(f"{INST_BOS}[SYSTEM_PROMPT]"), system, F.lit("[/SYSTEM_PROMPT]"))
    return F.concat(F.array(_segment(opening)), F.transform(_without_first_system(messages), turn))


def fallback_turn(role: Column, content: Column) -> Column:
    return F.concat(
        F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(content, F.lit("")), F.lit("\n")
    )


def fallback(messages: Column) -> Column:
    return F.transform(messages, lambda m: _segment(fallback_turn(m["role"], m["content"])))
