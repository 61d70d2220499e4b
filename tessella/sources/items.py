"""Reader for prompt/target items with validation, task filter and an optional reject table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import compute_once
from tessella.functions.text import is_blank, strip
from tessella.operators.paragraphs import record_id
from tessella.sources.corpus import field_of, json_object
from tessella.sources.lines import number_scanned, scan_lines

# Task lists of the presets (None takes every task) and whether ids are kept.
ITEM_PRESETS: dict[str, tuple[tuple[str, ...] | None, bool]] = {
    "current": (None, False),
    "six_tasks": (
        ("translate_idiomatic", "transform", "construct_tagging", "translate_literal", "morphosyntax", "contrast_judge"),
        False,
    ),
    "three_tasks": (("translate_idiomatic", "transform", "contrast_judge"), True),
}


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _as_text(value: Column) -> Column:
    """Text of a JSON scalar the way Python prints it; lists and objects give null."""
    kind = _kind(value)
    plain = value.cast("string")
    number = value.cast("double")
    small = (F.abs(number) < 1e16) & ((F.abs(number) >= 1e-4) | (number == 0))
    fixed = F.regexp_replace(number.cast("decimal(38,17)").cast("string"), r"(\.\d*?[1-9]|\.0)0+$", "$1")
    return (
        F.when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(plain))
        .when(kind == "DOUBLE", F.when(small, fixed).otherwise(F.lower(plain)))
        .when(kind.startswith("DECIMAL"), F.when(small, fixed).otherwise(F.lower(number.cast("string"))))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(None).cast("string"))
        .otherwise(plain)
    )


def _judged(numbered: DataFrame) -> DataFrame:
    rows = compute_once(numbered.filter(~is_blank(F.col("value"))), "_o", json_object(F.col("value")))
    has = {k: F.map_contains_key("_o", k) for k in ("prompt", "target", "id")}
    field = {k: field_of(F.col("_o"), k) for k in ("prompt", "target", "id", "task")}
    nested = [F.when(has[k], _as_text(field[k]).isNull()).otherwise(F.lit(False)) for k in ("prompt", "target")]
    reason = (
        F.when(F.col("_o").isNull(), "invalid JSON")
        .when(~(has["prompt"] & has["target"]), "missing 'prompt' or 'target' field")
        .when(nested[0] | nested[1], "list or object as text")
    )
    fields = F.struct(
        reason.alias("reason"),
        F.when(has["id"], _as_text(field["id"])).otherwise(record_id(F.col("line_no"), "item", 6)).alias("id"),
        field["task"].cast("string").alias("task"),
        strip(_as_text(field["prompt"])).alias("prompt"),
        strip(_as_text(field["target"])).alias("target"),
    )
    return compute_once(rows, "_fields", fields).select("file", "line_no", "_fields.*")


def items_from_lines(
    numbered: DataFrame,
    tasks: Sequence[str] | None = None,
    keep_id: bool = False,
    on_error: str = "fail",
    keep_position: bool = False,
) -> DataFrame:
    """Valid items of numbered JSON lines.

    Required fields are checked before the task filter; items empty after stripping are dropped.
    ``on_error='fail'`` stops at a bad line, ``'quarantine'`` leaves it to ``item_rejects``.
    ``keep_position`` keeps file and line number, the order of the items.
    """
    judged = _judged(numbered)
    wanted = (F.col("prompt") != "") & (F.col("target") != "")
    if tasks is not None:
        wanted = F.coalesce(F.col("task").isin(*tasks), F.lit(False)) & wanted
    bad = F.lit(False)
    if on_error == "fail":
        # One condition, so that no part of it can drop a bad line before it is reported.
        bad = F.raise_error(F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("reason"))).cast("boolean")
    kept = judged.filter(F.when(F.col("reason").isNull(), wanted).otherwise(bad))
    place = ["file", "line_no"] if keep_position else []
    return kept.select(*place, "prompt", "target", *(["id"] if keep_id else []))


def item_rejects(numbered: DataFrame) -> DataFrame:
    return _judged(numbered).filter(F.col("reason").isNotNull()).select("file", "line_no", "reason")


def read_items(
    spark: SparkSession, path: str, preset: str = "current", on_error: str = "fail", require_rows: bool = True
) -> DataFrame:
    """Items of a JSON lines file or folder by preset; no valid item at all is an error."""
    tasks, keep_id = ITEM_PRESETS[preset]
    items = items_from_lines(number_scanned(scan_lines(spark, path)), tasks, keep_id, on_error)
    if require_rows and items.isEmpty():
        raise ValueError("no valid items found")
    return items
