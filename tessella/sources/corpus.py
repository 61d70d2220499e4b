"""Corpus readers: JSON lines, plain text, or a mix, as ``file, ordinal, id, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import compute_once
from tessella.functions.text import drop_bad_bytes, is_blank
from tessella.operators.paragraphs import record_id, text_paragraphs
from tessella.sources.lines import number_lines, number_scanned, scan_bundles, scan_lines

JSON_OBJECT = "map<string,variant>"


STRICT = {"allowSingleQuotes": "false"}


def json_object(line: Column) -> Column:
    """The fields of a line that is exactly one JSON object, else null.

    The reader ignores what follows a value. Inside a list and as a field of an object it does not,
    and each of the two finds text that closes the other one; so a line must be read as both. Of a
    repeated name the last value counts, as the list form keeps all of them in order.
    """
    listed = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<{JSON_OBJECT}>", STRICT)
    named = F.from_json(F.concat(F.lit('{"r":'), line, F.lit("}")), f"r {JSON_OBJECT}, _bad string", {**STRICT, "columnNameOfCorruptRecord": "_bad"})
    return F.when((F.size(listed) == 1) & named["_bad"].isNull() & named["r"].isNotNull(), F.get(listed, F.lit(0)))


def field_of(fields: Column, name: str) -> Column:
    """The last value under a name; null if there is none."""
    same = F.filter(F.map_entries(fields), lambda e: e["key"] == name)
    return F.get(same, F.size(same) - 1)["value"]


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _first_string(fields: Column) -> Column:
    """``text`` if it is a string, else the first string value in key order."""
    own = field_of(fields, "text")
    others = F.filter(F.map_values(fields), is_string)
    return F.when(is_string(own), own.cast("string")).otherwise(F.get(others, F.lit(0)).cast("string"))


def json_records(numbered: DataFrame, on_error: str = "fail") -> DataFrame:
    """Records of numbered JSON lines. Blank lines are skipped but counted.

    A line without any string is an error; with ``on_error='quarantine'`` the row is kept with a
    ``reason`` and no text instead.
    """
    fields = compute_once(numbered.filter(~is_blank(F.col("value"))), "_o", json_object(F.col("value")))
    named = F.coalesce(F.map_contains_key("_o", "id"), F.lit(False))
    rows = fields.select(
        "file",
        F.col("line_no").alias("ordinal"),
        # An explicit null stays null.
        F.when(named, field_of(F.col("_o"), "id").cast("string")).otherwise(record_id(F.col("line_no"))).alias("id"),
        _first_string(F.col("_o")).alias("text"),
    )
    reason = F.concat(F.lit("line "), F.col("ordinal"), F.lit(" has no string field to use as text"))
    if on_error == "quarantine":
        return rows.withColumn("reason", F.when(F.col("text").isNull(), reason))
    return rows.withColumn("text", F.coalesce("text", F.raise_error(reason).cast("string")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def records_from_lines(lines: DataFrame, numbered: Column | None = None) -> DataFrame:
    """Each file by its extension: ``.jsonl`` as JSON lines, ``.txt`` as paragraphs (``numbered`` as in ``text_paragraphs``)."""
    known = F.when(extension(F.col("file")).isin(".jsonl", ".txt"), F.col("file")).otherwise(
        F.raise_error(F.concat(F.lit("unsupported input format: "), F.col("file"))).cast("string")
    )
    checked = lines.withColumn("file", known)
    as_json = json_records(number_lines(checked.filter(extension(F.col("file")) == ".jsonl")))
    as_text = text_paragraphs(checked.filter(extension(F.col("file")) == ".txt"), numbered)
    return as_json.unionByName(as_text)


def read_corpus_jsonl(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return json_records(number_scanned(scan_lines(spark, path)), on_error)


def read_corpus_text(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Paragraphs of text files; ``bundled`` files lie in those of ``lines.write_bundles``."""
    return text_paragraphs(scan_bundles(spark, path) if bundled else scan_lines(spark, path))


def read_plain_text(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Text files as they are, for token blocks: one row per line, ``key`` running over all files.

    Bytes that cannot be decoded are left out. White space does not matter to the blocks, so lines
    need not be joined again. ``bundled`` as in ``read_corpus_text``; the order is by the names of the files.
    """
    numbered = number_scanned(scan_bundles(spark, path) if bundled else scan_lines(spark, path), within=())
    return numbered.select((F.col("line_no") - 1).alias("key"), drop_bad_bytes(F.col("value")).alias("text"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A file or a folder of ``.jsonl`` and ``.txt`` files; any other extension is an error."""
    return records_from_lines(scan_lines(spark, path))
