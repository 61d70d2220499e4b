"""Helpers on DataFrames that are about how often an expression is evaluated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row, however often it is used later.

    The optimizer copies the expression of a plain column into filters and projections above it,
    which for parsing or regular expressions means doing the work several times. It also puts
    "array is not empty" filters in front of every explode, with the whole array expression in them.
    Nothing is copied through the explode of a one-element array, which costs next to nothing.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` names it. For expressions inside
    one another, where ``compute_once`` has no column to add."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
