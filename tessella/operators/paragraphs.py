"""Cut line tables into paragraphs, paragraphs into sentences.

A line table has ``file``, ``chunk`` (a bounded piece of the file, in file order), ``pos`` (order
within the chunk) and ``value``. A file may be of any size: its chunks are worked on apart and
only narrow per-chunk facts are carried from one to the next.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessella.functions.columns import compute_once
from tessella.functions.text import WHITESPACE_CLASS, is_blank, strip
from tessella.functions.wording import ORTHOGRAPHY_POLICY

# A label opens a paragraph; the space after the dot may be missing.
LABEL = rf"(?Us)^[{WHITESPACE_CLASS}]*(\d+)\.[{WHITESPACE_CLASS}]*(.*)$"
# The decimal digits of all other scripts; each script has its ten in a row, from zero on.
DIGITS = "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd")
SENTENCE = r"[^.!?]+[.!?]*"
GREEK = r"\p{IsGreek}+(?:\s+\p{IsGreek}+)*"


def _in_chunk() -> WindowSpec:
    return Window.partitionBy("file", "chunk").orderBy("pos")


def record_id(number: Column, prefix: str = "rec", width: int = 4) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number.cast("long"))


def label_number(label: Column) -> Column:
    """The number of a label as text, of any length, without leading zeros and in ASCII digits."""
    return F.regexp_replace(F.translate(label, DIGITS, "0123456789" * (len(DIGITS) // 10)), "^0+(?=[0-9])", "")


def _chunk_facts(lines: DataFrame, numbered: Column) -> DataFrame:
    """One narrow row per file and chunk: how its file is cut and how many paragraphs came before.

    ``numbered`` fixes the way of cutting by the name of the file; null settles it per file: by numbers
    if there is a label with text after it, in its own line or in a later line that is no label.
    """
    opened, filled = F.col("value").rlike(LABEL), ~is_blank(F.col("value"))
    tail = F.when(opened, F.regexp_extract("value", LABEL, 2))
    narrow = lines.select(
        "file", "chunk", "pos", opened.alias("opened"), filled.alias("filled"), (tail != "").alias("inline")
    )
    counted = narrow.withColumn("start", F.col("filled") & ~F.coalesce(F.lag("filled").over(_in_chunk()), F.lit(False)))
    facts = counted.groupBy("file", "chunk").agg(
        F.count_if("opened").alias("labels"),
        F.count_if("start").alias("starts"),
        F.min_by("filled", "pos").alias("first_filled"),
        F.max_by("filled", "pos").alias("last_filled"),
        F.min(F.when(F.col("opened"), F.struct("chunk", "pos"))).alias("label_at"),
        F.max(F.when(F.col("filled") & ~F.col("opened"), F.struct("chunk", "pos"))).alias("body_at"),
        F.bool_or("inline").alias("inline"),
    )
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    follows = F.max(F.col("body_at")).over(whole) > F.min(F.col("label_at")).over(whole)
    by_number = F.coalesce(numbered, F.bool_or("inline").over(whole) | follows, F.lit(False))
    # A chunk that begins in the middle of a paragraph does not start a new one.
    running_on = (F.col("first_filled") & F.lag("last_filled").over(whole.orderBy("chunk"))).cast("long")
    merged = facts.withColumn("merged", F.coalesce(running_on, F.lit(0)))
    starts = F.coalesce(F.sum(F.col("starts") - F.col("merged")).over(earlier), F.lit(0)) - F.col("merged")
    labels = F.coalesce(F.sum("labels").over(earlier), F.lit(0))
    by_file = merged.withColumn("_numbered", by_number)
    return by_file.select(
        "file", "chunk", "_numbered", F.when(F.col("_numbered"), labels).otherwise(starts).alias("_before")
    )


def _paragraphs(lines: DataFrame, numbered: Column) -> DataFrame:
    """``file, ordinal, label, id, text``: one scan for the chunk facts, one for the texts.

    The lines are shuffled and sorted once by file and chunk, which serves the window, the join and
    the first grouping; one row per paragraph and chunk is left for the second grouping.
    """
    seen = lines.withColumn("_open", F.col("value").rlike(LABEL)).withColumn("_filled", ~is_blank(F.col("value")))
    first = F.col("_filled") & ~F.coalesce(F.lag("_filled").over(_in_chunk()), F.lit(False))
    so_far = _in_chunk().rowsBetween(Window.unboundedPreceding, 0)
    counted = seen.withColumn("_start", first).select(
        "*",
        F.sum(F.col("_open").cast("long")).over(so_far).alias("_labels"),
        F.sum(F.col("_start").cast("long")).over(so_far).alias("_starts"),
    )
    placed = counted.join(_chunk_facts(lines, numbered).hint("merge"), ["file", "chunk"]).withColumn(
        "ordinal", F.col("_before") + F.when(F.col("_numbered"), F.col("_labels")).otherwise(F.col("_starts"))
    )
    kept = placed.filter(F.when(F.col("_numbered"), F.col("ordinal") > 0).otherwise(F.col("_filled")))
    is_label = F.col("_numbered") & F.col("_open")
    # The label is removed. A bare label leaves an empty first line, which the strip takes away.
    line = F.when(is_label, F.regexp_extract("value", LABEL, 2)).otherwise(F.col("value"))
    number = F.when(is_label, label_number(F.regexp_extract("value", LABEL, 1)))
    fragments = (
        kept.select("file", "chunk", "ordinal", "pos", "_numbered", line.alias("value"), number.alias("label"))
        .groupBy("file", "chunk", "ordinal", "_numbered")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_lines"), F.max("label").alias("label"))
        .withColumn("_part", F.array_join(F.transform("_lines", lambda x: x["value"]), "\n"))
    )
    whole = fragments.groupBy("file", "ordinal", "_numbered").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "_part"))).alias("_parts"), F.max("label").alias("label")
    )
    text = strip(F.array_join(F.transform("_parts", lambda x: x["_part"]), "\n"))
    named = F.when(F.col("_numbered"), F.col("label")).otherwise(F.col("ordinal").cast("string"))
    padded = F.lpad(named, F.greatest(F.length(named), F.lit(4)), F.lit("0"))
    return (
        compute_once(whole, "text", text)
        .filter(F.col("text") != "")
        .select("file", "ordinal", "label", F.concat(F.lit("rec"), padded).alias("id"), "text")
    )


def numbered_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs opened by a numbered line; lines before the first label are dropped.

    Labels may repeat, so the key is (file, ordinal) and the id repeats with the label.
    """
    return _paragraphs(lines, F.lit(True))


def blank_line_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs set apart by blank lines, numbered from 1 in each file."""
    return _paragraphs(lines, F.lit(False)).drop("label")


def text_paragraphs(lines: DataFrame, numbered: Column | None = None) -> DataFrame:
    """Numbered paragraphs; blank-line paragraphs for the files that have none of those.

    A line that begins with an address or a decimal number looks like a label. ``numbered``, a condition on
    ``file``, says for files whose form is known whether they have labels; where it is null the lines decide.
    """
    return _paragraphs(lines, F.lit(None).cast("boolean") if numbered is None else numbered).drop("label")


def sentence_list(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def mark_foreign(text: Column) -> Column:
    return F.regexp_replace(text, f"({GREEK})", "<GRC>$1</GRC>")


def foreign_list(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(GREEK), F.lit(0)),
        lambda s: F.struct(F.lit("grc").alias("lang"), s.alias("text")),
    )


def segment(paragraphs: DataFrame) -> DataFrame:
    """Rule-based segments with the fields of a teacher segmentation. No spelling is changed."""
    found = compute_once(
        paragraphs,
        "_found",
        F.struct(mark_foreign(F.col("text")).alias("marked"), foreign_list(F.col("text")).alias("spans")),
    )
    cut = compute_once(found.drop("text"), "sentences", sentence_list(F.col("_found.marked")))
    return cut.select(
        "id",
        "paragraph_index",
        F.lit(ORTHOGRAPHY_POLICY).alias("orthography_policy"),
        F.col("_found.marked").alias("normalized_paragraph"),
        "sentences",
        F.col("_found.spans").alias("foreign_spans"),
    )


def explode_sentences(segments: DataFrame) -> DataFrame:
    return segments.select("id", "paragraph_index", F.posexplode("sentences").alias("_i", "sentence")).select(
        "id", "paragraph_index", (F.col("_i") + 1).cast("long").alias("sentence_index"), "sentence"
    )
