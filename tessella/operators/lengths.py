"""Token lengths of conversations and what follows from their distribution.

All reports come from one row: exact percentiles, moments and the histogram of distinct lengths.
That histogram is bounded by the longest text, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import render
from tessella.functions.text import DEFAULT_TOKENIZER, Tokenizer, count_tokens, strip
from tessella.operators.conversations import usable_turns
from tessella.operators.ordering import ordinals
from tessella.storage import cut_lineage

SUMMARY_PERCENTILES = {"p50": 50.0, "p90": 90.0, "p95": 95.0, "p99": 99.0, "p995": 99.5}
ALTERNATIVE_PERCENTILES = (98.0, 99.0, 99.5, 99.9)
NO_LIMIT = 10_000_000


def llama_token_counts(turns: DataFrame, date: str = render.LLAMA_DATE) -> DataFrame:
    """Tokens per conversation in the Llama layout, without building the conversation.

    Segments begin and end with markers that no token can span, so counts add up over turns: each
    turn is counted where it is read and only (key, number) pairs are shuffled, combined map-side.
    A system turn in first place is part of the opening block, so its own block is taken off again.
    """
    block = count_tokens(render.llama_turn(F.col("role"), F.col("text")))
    inside = F.when(F.col("role") == "system", count_tokens(strip(F.col("text")))).otherwise(F.lit(0))
    counted = usable_turns(turns).select(
        "conv_id",
        "turn",
        block.alias("n"),
        F.when(F.col("role") == "assistant", F.lit(1)).otherwise(F.lit(0)).alias("mine"),
        F.when(F.col("role") == "system", inside - block).otherwise(F.lit(0)).alias("if_first"),
    )
    opening = count_tokens(render.llama_opening(F.lit(""), date))
    return counted.groupBy("conv_id").agg(
        (F.sum("n") + F.min_by("if_first", "turn") + opening).cast("long").alias("num_tokens"),
        F.sum(F.col("n") * F.col("mine")).cast("long").alias("assistant_tokens"),
    )


def fallback_token_counts(turns: DataFrame) -> DataFrame:
    block = count_tokens(render.fallback_turn(F.col("role"), F.col("text")))
    return usable_turns(turns).groupBy("conv_id").agg(F.sum(block).cast("long").alias("num_tokens"))


def rendered_token_counts(rendered: DataFrame, key: str = "conv_id", tokenizer: Tokenizer = DEFAULT_TOKENIZER) -> DataFrame:
    """Token counts of conversations rendered in any format, by any tokenizer."""
    return rendered.select(key, tokenizer.count(F.col("text")).alias("num_tokens"))


def length_table(counts: DataFrame, key: str = "conv_id") -> DataFrame:
    """Zero-based index in key order and the length of each example.

    Counting reads all texts, so its narrow result is kept on disk before it is numbered.
    """
    numbered = ordinals(cut_lineage(counts.select(key, "num_tokens")), key)
    return numbered.select((F.col("ordinal") - 1).alias("index"), "num_tokens")


def length_profile(lengths: DataFrame, percentiles: Sequence[float] = ()) -> DataFrame:
    """One row: moments, exact percentiles and the histogram, all from distinct lengths."""
    asked = sorted({*SUMMARY_PERCENTILES.values(), *ALTERNATIVE_PERCENTILES, *percentiles})
    histogram = lengths.groupBy("num_tokens").agg(F.count("*").alias("c"))
    c = F.col("c")
    row = histogram.agg(
        F.sum("c").cast("long").alias("n"),
        F.min("num_tokens").cast("long").alias("min_tokens"),
        F.max("num_tokens").cast("long").alias("max_tokens"),
        F.sum(F.col("num_tokens") * c).cast("long").alias("total_tokens"),
        F.percentile("num_tokens", [p / 100 for p in asked], c).alias("_p"),
        F.collect_list(F.struct(F.col("num_tokens").alias("x"), c.alias("c"))).alias("histogram"),
    )
    mean = F.col("total_tokens") / F.col("n")
    # Population variance around the mean, summed over the histogram to avoid cancellation.
    spread = F.aggregate(
        "histogram", F.lit(0.0), lambda acc, b: acc + (b["x"] - mean) * (b["x"] - mean) * b["c"].cast("double")
    )
    return row.select(
        "n",
        "min_tokens",
        "max_tokens",
        "total_tokens",
        "histogram",
        mean.alias("mean_tokens"),
        F.sqrt(spread / F.col("n")).alias("std_tokens"),
        F.map_from_arrays(F.array(*[F.lit(p) for p in asked]), "_p").alias("percentiles"),
    ).filter("n > 0")


def percentile_of(p: float) -> Column:
    return F.element_at("percentiles", F.lit(p))


def longer_than(limit: Column) -> Column:
    return F.aggregate(
        F.filter("histogram", lambda b: b["x"] > limit), F.lit(0).cast("long"), lambda acc, b: acc + b["c"]
    )


def suggestion(percentile: Column, model_limit: int | None = None) -> Column:
    """The percentile rounded up to whole tokens, then to a multiple of eight, then capped."""
    candidate = (F.ceil(F.ceil(percentile) / 8.0) * 8).cast("long")
    if model_limit and model_limit < NO_LIMIT:
        return F.least(candidate, F.lit(model_limit).cast("long"))
    return candidate


def length_summary(profile: DataFrame) -> DataFrame:
    return profile.select(
        "n",
        "min_tokens",
        "max_tokens",
        F.round("mean_tokens", 6).alias("mean_tokens"),
        F.round("std_tokens", 6).alias("std_tokens"),
        *[F.round(percentile_of(p), 6).alias(name) for name, p in SUMMARY_PERCENTILES.items()],
    )


def suggest_length(profile: DataFrame, model_limit: int | None = None, percentile: float = 99.0) -> DataFrame:
    """``percentile`` must be one the profile was built with."""
    value = suggestion(percentile_of(percentile), model_limit)
    capped = F.lit(False)
    if model_limit and model_limit < NO_LIMIT:
        capped = value >= model_limit
    return profile.select(
        F.lit(float(percentile)).alias("percentile"),
        value.alias("max_length"),
        capped.alias("capped"),
        longer_than(value).alias("longer"),
        F.round(longer_than(value) / F.col("n"), 6).alias("truncation_rate"),
    )


def suggest_alternatives(profile: DataFrame, model_limit: int | None = None) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("percentile"), suggestion(percentile_of(p), model_limit).alias("max_length"))
            for p in ALTERNATIVE_PERCENTILES
        ]
    )
    each = profile.select("n", "histogram", F.explode(rows).alias("s"))
    return each.select(
        "s.percentile",
        "s.max_length",
        F.round(longer_than(F.col("s.max_length")) / F.col("n"), 6).alias("truncation_rate"),
    )


def length_histogram(profile: DataFrame, bins: int = 50) -> DataFrame:
    """Equal bins from the shortest to the longest; the last one is closed on the right.

    If all lengths are equal the range is one token wide around them. Empty bins are listed.
    """
    low, high = F.col("min_tokens"), F.col("max_tokens")
    flat = low == high
    left = F.when(flat, low - 0.5).otherwise(low.cast("double"))
    width = F.when(flat, F.lit(1.0)).otherwise((high - low).cast("double")) / bins
    place = F.when(flat, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("b.x") - low) * bins / F.nullif(high - low, F.lit(0))), F.lit(bins - 1))
    )
    filled = profile.select("min_tokens", "max_tokens", F.explode("histogram").alias("b")).groupBy(
        place.cast("long").alias("bin")
    ).agg(F.sum("b.c").alias("c"))
    edges = profile.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"),
        left.alias("left"),
        width.alias("width"),
    )
    return edges.join(filled, "bin", "left").select(
        "bin",
        F.round(F.col("left") + F.col("bin") * F.col("width"), 6).alias("bin_start"),
        F.coalesce("c", F.lit(0)).cast("long").alias("examples"),
    )


def padding_report(profile: DataFrame, max_length: Column) -> DataFrame:
    """Padding if every row shorter than ``max_length`` is filled up to it."""
    padded = F.aggregate(
        "histogram",
        F.lit(0).cast("long"),
        lambda acc, b: acc + F.greatest(max_length - b["x"], F.lit(0).cast("long")) * b["c"],
    )
    return profile.select(
        max_length.alias("max_length"), "total_tokens", padded.alias("padding_tokens")
    ).withColumn(
        "padding_share",
        F.round(F.coalesce(F.try_divide("padding_tokens", F.col("total_tokens") + F.col("padding_tokens")), F.lit(0.0)), 6),
    )
