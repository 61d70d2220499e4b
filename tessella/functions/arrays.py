"""Arrays inside one row: running sums and look-ups whose cost does not grow with the square of their length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import compute_once

CHUNK = 256


def _summed(values: Column) -> Column:
    """Inclusive running sums, one array longer per step: for short arrays."""

    def step(sums: Column, x: Column) -> Column:
        return F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0).cast("long")) + x))

    return F.aggregate(values, F.array().cast("array<bigint>"), step)


def with_running_sums(df: DataFrame, out: str, values: Column) -> DataFrame:
    """Adds the inclusive running sums of an array of numbers: within chunks, then over the sums of the chunks.

    Each step is a column of its own: an expression inside a lambda would be evaluated per element.
    """
    chunks = F.transform(
        F.when(F.size("_v") > 0, F.sequence(F.lit(0), F.floor((F.size("_v") - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda c: _summed(F.slice("_v", c * CHUNK + 1, F.lit(CHUNK))),
    )
    cut = compute_once(compute_once(df, "_v", values), "_chunks", chunks)
    totals = compute_once(cut, "_before", _summed(F.transform("_chunks", lambda c: F.element_at(c, F.lit(-1)))))
    none = F.lit(0).cast("long")
    placed = F.transform("_chunks", lambda c, i: F.transform(c, lambda x: x + F.when(i > 0, F.get("_before", i - 1)).otherwise(none)))
    return compute_once(totals, out, F.flatten(placed)).drop("_v", "_chunks", "_before")


def count_below(ordered: Column, limit: Column, at: callable = lambda x: x) -> Column:
    """How many entries of an ascending array are smaller than ``limit``, by halving; ``at`` gives an entry's value."""
    n = F.size(ordered)
    turns = F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = (s["low"] < s["high"]) & (at(F.get(ordered, middle)) < limit)
        return F.struct(
            F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when(below | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high")
        )

    return F.aggregate(turns, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda s: s["low"])
