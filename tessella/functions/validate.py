"""Strict validation of JSON bodies against a type description, with the place of the first fault.

A description (``Record``, ``ListOf`` and the scalars) generates the Spark type of the value, and a walk
over the parsed body that tells absent from null from a wrong type. The walk decides. Bodies whose
whole schema reads as described and whose values have no null where none may be are accepted
before it, which is nearly all of them; that test is generated from the same description. Of the
others, lists are tested the same way before their items are walked over. Every value is taken out once.

A body must be exactly one JSON value: text after it, single quotes and other laxness are not
JSON, and neither is an object that repeats a name. Fields that the description lacks are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import bound, compute_once

FAULT = "struct<path:string,reason:string>"
FOUND = "struct<path:string,reason:string,value:variant>"  # a fault within the walk; its value is put into words at the end
END = "␀end"  # closes the list a body is parsed in; no body may contain it


def _kind(value: Column) -> Column:
    """What a parsed value is, in words."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema == "STRING", "text")
        .when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "a boolean")
        .when(schema == "BIGINT", "an integer")
        .when(schema.startswith("ARRAY"), "a list")
        .when(schema.startswith("OBJECT"), "an object")
        .otherwise("a number")
    )


def _fault(at: Column, reason: str) -> Column:
    return F.struct(at.alias("path"), F.lit(reason).alias("reason"), F.lit(None).cast("variant").alias("value"))


def _wrong(value: Column, at: Column, wanted: str) -> Column:
    return F.struct(at.alias("path"), F.lit(f", not {wanted}").alias("reason"), value.alias("value"))


def _none() -> Column:
    return F.lit(None).cast(FOUND)


def _in_words(found: Column) -> Column:
    """What a walk found as path and reason, null if it found nothing."""
    reason = F.when(found["value"].isNull(), found["reason"]).otherwise(F.concat(_kind(found["value"]), found["reason"]))
    return F.when(found.isNotNull(), F.struct(found["path"].alias("path"), reason.alias("reason")))


def _as_described(value: Column, typed: Column, kind: ListOf | Record) -> Column:
    """True only for values without fault, though not for all of them."""
    return F.schema_of_variant(value).rlike(f"^{kind.pattern()}$") & F.coalesce(kind.complete(typed), F.lit(False))


@dataclass(frozen=True)
class Scalar:
    """A value of one kind: ``schema`` as the parser names it, ``sql`` as Spark keeps it."""

    schema: str
    sql: str
    words: str

    def pattern(self) -> str:
        return self.schema

    def complete(self, typed: Column) -> Column:
        return typed.isNotNull()

    def fault(self, value: Column, at: Column) -> Column:
        small = F.try_variant_get(value, "$", self.sql).isNotNull()
        return F.when(F.schema_of_variant(value) != self.schema, _wrong(value, at, self.words)).when(
            ~small, _fault(at, f"out of the range of {self.words}")
        )


TEXT = Scalar("STRING", "string", "text")
WHOLE = Scalar("BIGINT", "int", "an integer")
FLAG = Scalar("BOOLEAN", "boolean", "a boolean")


@dataclass(frozen=True)
class ListOf:
    item: Scalar | Record

    @property
    def sql(self) -> str:
        return f"array<{self.item.sql}>"

    def pattern(self) -> str:
        return f"ARRAY<(?:{self.item.pattern()}|VOID)>"  # VOID: no items, or nulls, which ``complete`` finds

    def complete(self, typed: Column) -> Column:
        return F.coalesce(F.forall(typed, lambda x: F.coalesce(self.item.complete(x), F.lit(False))), F.lit(False))

    def fault(self, value: Column, at: Column) -> Column:
        def of_item(x: Column, i: Column) -> Column:
            place = F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))
            return F.when(x.isNull(), _fault(place, "null")).otherwise(self.item.fault(x, place))

        def walk(listed: Column) -> Column:
            found = F.get(F.filter(F.transform(listed, of_item), lambda f: f.isNotNull()), F.lit(0))
            return F.when(listed.isNull(), _wrong(value, at, "a list")).otherwise(found)

        walked = bound(F.try_variant_get(value, "$", "array<variant>"), walk)
        return F.when(_as_described(value, F.try_variant_get(value, "$", self.sql), self), _none()).otherwise(walked)


@dataclass(frozen=True)
class Field:
    """``absent``: the field may be left out. ``null``: it may be null."""

    name: str
    kind: Scalar | ListOf | Record
    absent: bool = False
    null: bool = False


@dataclass(frozen=True)
class Record:
    """An object; at least one field must be required."""

    fields: tuple[Field, ...]

    @property
    def sql(self) -> str:
        return f"struct<{','.join(f'{f.name}:{f.kind.sql}' for f in self.fields)}>"

    def pattern(self) -> str:
        """Names are in order. Each field but the first has a comma in front, so commas stand with optional ones."""
        out, before = "", False
        for f in sorted(self.fields, key=lambda f: f.name):
            one = f"{re.escape(f.name)}: (?:{f.kind.pattern()}{'|VOID' if f.null else ''})"
            if f.absent:
                out += f"(?:, {one})?" if before else f"(?:{one}, )?"
            else:
                out += f", {one}" if before else one
                before = True
        return f"OBJECT<{out}>"

    def complete(self, typed: Column) -> Column:
        out = F.lit(True)
        for f in self.fields:
            inner = typed[f.name]
            if not f.null:
                out = out & (inner.isNull() | f.kind.complete(inner) if f.absent else f.kind.complete(inner))
        return out

    def fault(self, value: Column, at: Column) -> Column:
        def of_field(f: Field) -> Column:
            place = F.concat(at, F.lit(f".{f.name}"))

            def walk(inner: Column) -> Column:
                one = F.when(inner.isNull(), _none() if f.absent else _fault(place, "missing"))
                if f.null:
                    one = one.when(F.is_variant_null(inner), _none())
                return one.otherwise(f.kind.fault(inner, place))

            return bound(F.try_variant_get(value, f"$.{f.name}", "variant"), walk)

        is_object = F.try_variant_get(value, "$", "map<string,variant>").isNotNull()
        # Only an object can have the required fields, so the question comes up after a fault alone.
        first = F.coalesce(*[of_field(f) for f in self.fields])
        return bound(first, lambda f: F.when(f.isNull(), _none()).when(~is_object, _wrong(value, at, "an object")).otherwise(f))


def with_body(df: DataFrame, body: str, out: str) -> DataFrame:
    """Adds the one JSON value of a body as VARIANT; null if there is none or anything beside it.

    It is parsed, once, as the first of two items of a list. A body that ended early would close the list
    before the second item.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(body), F.lit(f',"{END}"]'))), "$", "array<variant>")
    parsed = compute_once(df, "_listed", listed)
    pair = F.col("_listed")
    whole = (F.size(pair) == 2) & ~F.contains(body, F.lit(END)) & (F.get(pair, F.lit(1)).cast("string") == END)
    return parsed.withColumn(out, F.when(whole, F.get(pair, F.lit(0)))).drop("_listed")


def bare_fault(reason: str) -> Column:
    """A fault without a place."""
    return F.struct(F.lit(None).cast("string").alias("path"), F.lit(reason).alias("reason"))


def judged_body(df: DataFrame, body: str, kind: Record, use: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """Adds ``use(fault, typed)``: the first fault of a body in the order of the description, null if it has
    none, and the body as the Spark type of its description, which counts where there is no fault.

    The body is parsed once as VARIANT, as a field of an object whose other field is the body's hash: one that
    ended early would have to close the object with its own hash. The schema of that object tells the kinds of all
    values. The typed value is parsed from the text, which is faster than casting every value of the VARIANT; it
    never becomes a column, as rows that hold one are copied value by value.
    """
    text, mark, value = F.col(body), F.xxhash64(body), F.col("_closed")
    closed = F.concat(F.lit('{"b":'), text, F.lit(',"e":'), mark.cast("string"), F.lit("}"))
    own = F.try_variant_get(value, "$.e", "bigint") == mark
    described = own & F.schema_of_variant(value).rlike(f"^OBJECT<b: {kind.pattern()}, e: BIGINT>$")
    alone = own & (F.size(F.try_variant_get(value, "$", "map<string,variant>")) == 2)  # no other field beside the body

    def walk(inner: Column) -> Column:
        return F.when(inner.isNull(), bare_fault("not one JSON value")).otherwise(bound(kind.fault(inner, F.lit("$")), _in_words))

    def of_typed(typed: Column) -> Column:
        sound = F.coalesce(F.when(described, kind.complete(typed)), F.lit(False))
        walked = bound(F.when(alone, F.try_variant_get(value, "$.b", "variant")), walk)
        fault = F.when(text.isNull(), bare_fault("no response")).when(sound, F.lit(None).cast(FAULT)).otherwise(walked)
        return bound(fault, lambda f: use(f, typed))

    parsed = compute_once(df, "_closed", F.try_parse_json(closed))
    return compute_once(parsed, out, bound(F.when(own, F.from_json(text, kind.sql)), of_typed)).drop("_closed", body)
