"""Items and turns as chat messages, rendered conversations, and what counts for the loss."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import render
from tessella.functions.arrays import count_below, with_running_sums
from tessella.functions.columns import compute_once
from tessella.functions.text import DEFAULT_TOKENIZER, Tokenizer, count_tokens, is_blank, strip


def _message(role: str, content: str) -> Column:
    return F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))


def to_prompt_completion(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c not in {"prompt", "target"}]
    return df.select(
        *kept,
        F.array(_message("user", "prompt")).alias("prompt"),
        F.array(_message("assistant", "target")).alias("completion"),
    )


def to_messages(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c not in {"prompt", "target"}]
    return df.select(*kept, F.array(_message("user", "prompt"), _message("assistant", "target")).alias("messages"))


def format_for_training(df: DataFrame, local: bool = False) -> DataFrame:
    """Local items become messages. Other tables stay if they have messages, and become
    prompt/completion if they have both columns; anything else stays, with a warning."""
    if local:
        return to_messages(df)
    if "messages" in df.columns:
        return df
    if {"prompt", "target"} <= set(df.columns):
        return to_prompt_completion(df)
    warnings.warn("columns not recognised as chat data; left unchanged", stacklevel=2)
    return df


def usable_turns(turns: DataFrame) -> DataFrame:
    """User and assistant texts are stripped; blank user turns are skipped."""
    cleaned = turns.withColumn(
        "text", F.when(F.col("role").isin("user", "assistant"), strip(F.col("text"))).otherwise(F.col("text"))
    )
    return cleaned.filter(~((F.col("role") == "user") & is_blank(F.col("text"))))


def assemble(turns: DataFrame, system: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """One ordered message list per conversation, which is the row the renderers need.

    Counting does not need it: see ``lengths.llama_token_counts`` for sums without the list.
    """
    message = F.struct("turn", "role", F.col("text").alias("content"), *extra)
    listed = usable_turns(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("_m"))
    fields = ["role", "content", *extra]
    messages = F.transform("_m", lambda m: F.struct(*[m[f].alias(f) for f in fields]))
    if system is not None:
        lead = [F.lit("system").alias("role"), F.lit(system).alias("content")]
        types = {f.name: f.dataType for f in turns.schema.fields}
        lead += [F.lit(None).cast(types[e]).alias(e) for e in extra]
        messages = F.concat(F.array(F.struct(*lead)), messages)
    return listed.select("conv_id", messages.alias("messages"))


def rendered(conversations: DataFrame, segments: Column) -> DataFrame:
    made = compute_once(conversations, "segments", segments).drop("messages")
    return made.withColumn("text", render.text_of(F.col("segments")))


def generation_requests(conversations: DataFrame, style: str = "llama") -> DataFrame:
    """Conversations rendered with the assistant header left open at the end."""
    make = {"llama": render.llama, "chatml": render.chatml}[style]
    return rendered(conversations, make(F.col("messages"), add_generation_prompt=True)).drop("segments")


def _mask_by_offsets(df: DataFrame, mode: str, tokenizer: Tokenizer) -> DataFrame:
    """Tokens of the whole text against the limits of the segments, both as offsets.

    A token counts if any of it lies in a segment that counts, so one that begins before a border counts too.
    """
    i = F.transform("segments", lambda s, i: F.when(s["train"] & (s["text"] != ""), i).otherwise(F.lit(-1)))
    counts = {
        "assistant": F.transform("segments", lambda s: s["train"]),
        "completion": F.transform("segments", lambda s, j: j == F.col("_last")),
        "all": F.transform("segments", lambda s: F.lit(True)),
    }
    if mode not in counts:
        raise ValueError(f"unknown loss mode: {mode}")
    sizes = F.transform(tokenizer.tokens(F.col("text")), lambda t: F.length(t).cast("long"))
    gaps = F.transform(tokenizer.gaps(F.col("text")), lambda g: F.length(g).cast("long"))
    sized = compute_once(compute_once(df, "_last", F.array_max(i)), "_t", F.struct(sizes.alias("n"), gaps.alias("gap")))
    # The end of each token: all tokens up to it and all gaps before them.
    placed = with_running_sums(sized, "_ends", F.zip_with(F.col("_t.n"), F.slice(F.col("_t.gap"), F.lit(1), F.size("_t.n")), lambda a, b: a + b))
    limits = with_running_sums(placed, "_limits", F.transform("segments", lambda s: F.length(s["text"]).cast("long")))
    held = compute_once(limits, "_counts", counts[mode])

    def flag(end: Column, size: Column) -> Column:
        first = count_below(F.col("_limits"), end - size + 1)  # the segment of the first character
        last = count_below(F.col("_limits"), end)
        return F.exists(F.slice("_counts", first + 1, last - first + 1), lambda c: c).cast("int")

    return held.withColumn("mask", F.zip_with("_ends", "_t.n", flag)).drop("_t", "_ends", "_limits", "_counts", "_last")


def loss_mask(df: DataFrame, mode: str = "assistant", tokenizer: Tokenizer = DEFAULT_TOKENIZER) -> DataFrame:
    """A 0/1 flag per token of each rendered row.

    ``assistant`` takes the marked segments, ``completion`` only the last of them, ``all`` every token.
    With a tokenizer that is not additive, tokens that cross a border of segments are placed by offset.
    """
    if not tokenizer.additive:
        return _mask_by_offsets(df, mode, tokenizer)
    count_tokens = tokenizer.count
    sized = F.transform(
        "segments", lambda s: F.struct(count_tokens(s["text"]).cast("int").alias("n"), s["train"].alias("train"))
    )
    if mode == "assistant":
        flags = F.transform(sized, lambda s: F.array_repeat(s["train"].cast("int"), s["n"]))
    elif mode == "completion":
        last = F.array_max(
            F.transform("segments", lambda s, i: F.when(s["train"], i).otherwise(F.lit(-1)))
        )
        flags = F.transform(sized, lambda s, i: F.array_repeat((i == last).cast("int"), s["n"]))
    elif mode == "all":
        flags = F.transform(sized, lambda s: F.array_repeat(F.lit(1), s["n"]))
    else:
        raise ValueError(f"unknown loss mode: {mode}")
    return df.withColumn("mask", F.flatten(flags))


def loss_mask_stats(turns: DataFrame, date: str = render.LLAMA_DATE) -> DataFrame:
    """Trained and total tokens of all conversations together, from per-turn sums.

    In the Llama layout each assistant turn is trained from its header to its end mark. One row per
    conversation is all that moves between tasks, never the texts.
    """
    from tessella.operators.lengths import llama_token_counts

    totals = llama_token_counts(turns, date)
    return totals.agg(
        F.sum("assistant_tokens").cast("long").alias("assistant_tokens"),
        F.sum("num_tokens").cast("long").alias("total_tokens"),
    ).withColumn("ratio", F.round(F.try_divide("assistant_tokens", "total_tokens"), 6))
